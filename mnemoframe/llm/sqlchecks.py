"""SQL for DuckDB that gives the rows of queries that SQL can express."""

from __future__ import annotations

from mnemoframe.llm import divergence
from mnemoframe.llm.conversation_repair import OP11_SQL
from mnemoframe.llm.line_dedup import OP7_SQL

_SPACE = r"[ \t\n\x0B\f\r]"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"list_filter(regexp_split_to_array({{}}, '{_SPACE}+'), lambda x: x <> '')"

OP8_SQL = f"""
with recursive words as (
  select doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} as w from documents
), sets as (
  select doc_id, list_sort(list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end)) as s from words
), classed as (
  select doc_id, len(s) as n_shingles, case when len(s) > 0 then min(doc_id) over (partition by s) else doc_id end as class_id, s from sets
), grams as (
  select class_id as c, n_shingles as n, unnest(s) as g from classed where doc_id = class_id
), links as (
  select a.c as a, b.c as b from grams a join grams b on a.g = b.g and a.c < b.c group by a.c, b.c, a.n, b.n
  having 100 * count(*) >= 75 * (a.n + b.n - count(*))
), edges as (
  select a as u, b as v from links union all select b, a from links
), reach as (
  select distinct u as node, u as seen from edges
  union
  select r.node, e.v from reach r join edges e on e.u = r.seen
), named as (
  select node, min(seen) as component from reach group by node
)
select doc_id, cast(n_shingles as bigint) as n_shingles, coalesce(component, class_id) as component_id, doc_id = coalesce(component, class_id) as kept, class_id
from classed left join named on node = class_id
"""


def _op3() -> str:
    classes = {"c_lower": "[a-z]", "c_upper": "[A-Z]", "c_mark": r"[.,;:!?''\"()\-]", "c_symbol": "[#*$%&|<>]", "c_digit": "[0-9]"}
    chars = ", ".join(f"length(solid) - length(regexp_replace(solid, '{p}', '', 'g')) as {n}" for n, p in classes.items())
    size = max(map(len, divergence.COMMON_WORDS.values()))
    count = lambda k: "case lang " + " ".join(f"when '{name}' then len(list_filter(w, lambda x: x = '{w[k]}'))" for name, w in divergence.COMMON_WORDS.items()) + " end"
    words = [f"w_{k}" for k in range(size)]
    hist = ", ".join(f"{count(k)} as {n}" for k, n in enumerate(words))
    bins = (list(divergence.BINS), [*words, "w_rest"])

    def js(names: list[str]) -> str:
        n, m = " + ".join(names), " + ".join(f"r_{x}" for x in names)
        parts = []
        for x in names:
            p, q = f"({x} / nullif(n_own, 0))", f"(r_{x} / nullif(n_all, 0))"
            parts.append(f"(case when {x} > 0 then {p} * log2(2 * {p} / ({p} + {q})) else 0 end + case when r_{x} > 0 then {q} * log2(2 * {q} / ({p} + {q})) else 0 end) / 2")
        inner = " + ".join(parts).replace("n_own", f"cast({n} as double)").replace("n_all", f"cast({m} as double)")
        return f"case when {n} > 0 and {m} > 0 then round(greatest({inner}, 0), 6) end"

    every = [*bins[0], *bins[1]]
    return f"""
with split as (
  select doc_id, lang, text, {_WORDS.format("coalesce(text, '')")} as w from documents
), solid as (
  select *, array_to_string(w, '') as solid, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) as l from split
), runs as (
  select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as t from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from split)
), often as (
  select doc_id, t from runs group by doc_id, t having count(*) > 1
), repeated as (
  select doc_id, count(distinct i + k) as n from (select r.doc_id, r.i, unnest([0, 1, 2]) as k from runs r join often o on o.doc_id = r.doc_id and o.t = r.t) group by doc_id
), counted as (
  select s.doc_id, lang, len(w) as n_words, length(solid) as word_chars, len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(r.n, 0) as n_repeat_words, {chars}, {hist}
  from solid s left join repeated r on r.doc_id = s.doc_id
), full_counts as (
  select *, word_chars - c_lower - c_upper - c_mark - c_symbol - c_digit as c_other, n_words - ({' + '.join(words)}) as w_rest from counted
), totals as (
  select lang as of_lang, {', '.join(f'sum({n}) as r_{n}' for n in every)} from full_counts group by lang
), judged as (
  select f.*, {js(bins[0])} as js_chars, {js(bins[1])} as js_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed
  from full_counts f join totals on of_lang is not distinct from lang
)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(c_symbol as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words, base_failed,
  not base_failed and coalesce(n_words < {divergence.CHAR_GUARD} or js_chars <= {divergence.CHAR_LIMIT}, true) and coalesce(n_words < {divergence.WORD_GUARD} or js_words <= {divergence.WORD_LIMIT}, true) as kept, js_chars, js_words
from judged
"""


CHECKS = {"op3_distribution_divergence": _op3(), "op7_line_dedup": OP7_SQL, "op8_minhash_near_dedup": OP8_SQL, "op11_conversation_repair": OP11_SQL}
