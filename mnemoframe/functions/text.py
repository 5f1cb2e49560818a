"""Text features and text rendering as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Sentence-structure and generic framing terms that never make two memories relevant.
STOP_TERMS = (
    "a about after all also am an and any are as at be been being but by can could did do does doing "
    "for from had has have having he her here him his how i if in into is it its me more most my no "
    "not of on or our out over please she should so some than that the their them then there these "
    "they this those to too under up very was we were what when where which while who why will with "
    "would you your enjoyment future preference preferences previously recommend recommendation "
    "recommendations stated use user"
).split()

# Byte limits of the data model.
MAX_REF_BYTES = 384
MAX_TEXT_BYTES = 64 * 1024
MAX_EVIDENCE_BYTES = 16 * 1024
MAX_WINDOW_BYTES = 3 * 1024 * 1024
MAX_QUERY_BYTES = 32 * 1024

_SPACE = r"(?U)\s"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def has_space(c: str | Column) -> Column:
    return _col(c).rlike(_SPACE)


def trimmed(c: str | Column) -> Column:
    """Unicode-aware trim."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def normalize_ws(c: str | Column) -> Column:
    """Runs of white space become one blank, ends trimmed."""
    return F.trim(F.regexp_replace(_col(c), r"(?U)\s+", " "))


def contains_observed(haystack: str | Column, needle: str | Column) -> Column:
    """Space-bounded containment of normalised text."""
    padded = lambda c: F.concat(F.lit(" "), normalize_ws(c), F.lit(" "))
    return F.contains(padded(haystack), padded(needle))


def is_latin(c: str | Column) -> Column:
    """At least one letter, and at least half of the letters are Latin."""
    letters = F.length(F.regexp_replace(_col(c), r"\P{L}+", ""))
    latin = F.length(F.regexp_replace(_col(c), r"[\P{IsLatin}\P{L}]+", ""))
    return (letters > 0) & (latin * 2 >= letters)


def topic_terms(c: str | Column) -> Column:
    """Distinct lower-case words of two or more characters without stop terms."""
    words = F.split(F.lower(_col(c)), r"[^\p{L}\p{Nd}]+")
    stop = F.split(F.lit(" ".join(STOP_TERMS)), " ")  # one literal, folded once
    return F.array_except(F.filter(words, lambda w: F.length(w) >= 2), stop)


def squeezed(c: str | Column) -> Column:
    """Lower case without any white space: the input of character grams."""
    return F.lower(F.regexp_replace(_col(c), _SPACE, ""))


def grams(c: str | Column, n: int) -> Column:
    """Character n-grams; a shorter text is one gram, an empty text has none."""
    def slide(chars: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(chars) - n),
                           lambda i: F.concat(*[F.get(chars, i + k) for k in range(n)]))

    t = _col(c)
    return F.when(F.length(t) == 0, F.array().cast("array<string>")).when(
        F.length(t) < n, F.array(t)).otherwise(let(F.split(t, ""), slide))


def alnum_grams(c: str | Column, n: int = 3) -> Column:
    """Distinct n-grams of lower-case letters and digits."""
    return F.array_distinct(grams(F.lower(F.regexp_replace(_col(c), r"[^\p{L}\p{N}]", "")), n))


def let(value: Column, body) -> Column:
    """Bind a value once for use inside higher-order functions (a lambda variable is evaluated once)."""
    return F.transform(F.array(value), body)[0]


def bigram_bag(c: str | Column) -> Column:
    """Exact multiset of character bigrams as distinct longs: code point, code point, occurrence.

    The occurrence number (21 bits each) turns a multiset intersection into ``array_intersect``. Sorting
    puts equal grams next to each other; the starts of the runs give the occurrence numbers without a shuffle.
    """
    empty = F.array().cast("array<bigint>")

    def numbered(codes: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(codes) - 1),
                          lambda i: (i == 0) | (F.get(codes, i - 1) != F.get(codes, i)))

        def runs(st: Column) -> Column:
            return F.flatten(F.transform(st, lambda b, j: F.transform(
                F.sequence(F.lit(0), F.coalesce(F.get(st, j + 1), F.size(codes)) - b - 1),
                lambda o: F.shiftleft(F.get(codes, b), 21) + o)))

        return let(starts, runs)

    def codes_of(points: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.size(points) - 2), lambda i: F.shiftleft(
            F.get(points, i), 21) + F.get(points, i + 1))
        return F.when(F.size(points) == 1, points).otherwise(F.array_sort(pairs))

    def bag(points: Column) -> Column:
        return let(codes_of(points), numbered)

    text = squeezed(c)
    points = F.transform(F.split(text, ""), lambda ch: F.ascii(ch).cast("bigint"))
    return F.when(F.length(text) == 0, empty).otherwise(let(points, bag))


def clamp(score: Column) -> Column:
    """NaN becomes 0; otherwise bounded to [0, 1]."""
    return F.when(F.isnan(score) | score.isNull(), 0.0).otherwise(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)))


def application_scope(scope_kind: str | Column) -> Column:
    return F.when(_col(scope_kind) == "agent", "self").otherwise("relation")


def utf8_prefix(c: str | Column, max_bytes: int | Column) -> Column:
    """Longest prefix of whole characters within ``max_bytes`` bytes.

    The byte cut may split one character; the widest whole prefix is at most three bytes shorter.
    """
    raw = F.encode(_col(c), "UTF-8")
    n = F.lit(max_bytes) if isinstance(max_bytes, int) else max_bytes
    cut = lambda k: F.substring(raw, F.lit(1), n - k)
    whole = lambda k: F.when(F.is_valid_utf8(cut(k).cast("string")), cut(k).cast("string"))
    return F.when(F.octet_length(_col(c)) <= n, _col(c)).when(n <= 0, "").otherwise(
        F.coalesce(whole(0), whole(1), whole(2), whole(3), F.lit("")))


def quoted_lines(c: str | Column) -> Column:
    """Every line prefixed with ``> `` so that it cannot pose as structure."""
    return F.concat(F.lit("> "), F.regexp_replace(_col(c), r"(\r\n|\r|\n)", "$1> "))


def role_order(role: str | Column) -> Column:
    r = _col(role)
    return F.when(r == "situation", 0).when(r == "agent_act", 1).when(r == "outcome", 2).otherwise(3)


def render_episode(sources: Column) -> Column:
    """Evidence text of one episode from ``array<struct<role, source_ref, actor_kind, text>>``."""
    ordered = F.array_sort(F.transform(sources, lambda s: F.struct(
        role_order(s["role"]).alias("o"), s["source_ref"].alias("ref"), s["role"].alias("role"),
        s["actor_kind"].alias("actor"), s["text"].alias("text"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat(
        F.upper(s["role"]), F.lit(" ["), s["actor"], F.lit("]\n"), s["text"])), "\n")


def render_constitution(ref: str | Column, text: str | Column) -> Column:
    quoted = F.concat(F.lit("> "), F.replace(_col(text), F.lit("\n"), F.lit("\n> ")))
    return F.when((_col(ref) == "") & (_col(text) == ""), "CONSTITUTION\nUNKNOWN\n\n").otherwise(F.concat(
        F.lit("CONSTITUTION\nMEMORY_REF "), _col(ref), F.lit("\n"), quoted, F.lit("\nEND_CONSTITUTION\n\n")))


def render_source(s: Column, actors: bool = True) -> Column:
    """One source block of a window."""
    actor = F.concat(F.lit("ACTOR "), s["actor_kind"], F.lit(" "), s["actor_ref"], F.lit("\n"))
    return F.concat(F.upper(s["role"]), F.lit("\n"), actor if actors else F.lit(""),
                    F.lit("SOURCE "), s["source_ref"], F.lit("\n"), s["text"], F.lit("\n"))


def render_window_episode(heading: str, episode: str | Column, session: str | Column, sources: Column,
                          actors: bool = True, roles: tuple[str, ...] | None = None) -> Column:
    """One episode of a window text; sources in (role, reference) order."""
    kept = sources if roles is None else F.filter(sources, lambda s: s["role"].isin(*roles))
    ordered = F.array_sort(F.transform(kept, lambda s: F.struct(
        s["role"].alias("role"), s["source_ref"].alias("source_ref"), s["actor_kind"].alias("actor_kind"),
        s["actor_ref"].alias("actor_ref"), s["text"].alias("text"))))
    blocks = F.array_join(F.transform(ordered, lambda s: render_source(s, actors)), "")
    return F.concat(F.lit(heading + " "), _col(episode), F.lit("\nSESSION "), _col(session), F.lit("\n"), blocks)


def mask_episode(kind: str | Column, text: str | Column) -> Column:
    """Replace episode, session, actor and source references in the header lines of EPISODE texts."""
    t = _col(text)
    head = F.regexp_replace(t, r"\AEPISODE [^\r\n]*(\r?\n)SESSION [^\r\n]*", "EPISODE <episode>$1SESSION <session>")
    actors = F.regexp_replace(
        head, r"(?m)(^(?:AGENT_ACT|OUTCOME|SITUATION)\r?\nACTOR [^ \r\n]*) [^\r\n]*$", "$1 <actor>")
    sources = F.regexp_replace(
        actors,
        r"(?m)(^(?:AGENT_ACT|OUTCOME|SITUATION)\r?\n(?:ACTOR [^ \r\n]* [^\r\n]*\r?\n)?)SOURCE [^\r\n]*$",
        "$1SOURCE <source>")
    structural = t.rlike(r"\AEPISODE [^\r\n]*\r?\nSESSION ")
    return F.when((F.lower(_col(kind)) == "episode") & structural, sources).otherwise(t)


def chunk_tokens(tokens: Column, size: int = 220, overlap: int = 32) -> Column:
    """Overlapping chunks of a token array; the chunk that reaches the end is the last."""
    step = size - overlap
    last = F.greatest(F.ceil((F.size(tokens) - size) / F.lit(step)), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last),
                       lambda i: F.slice(tokens, i * F.lit(step) + 1, F.lit(size)))


def formation_query(sources: Column, agent: str | Column, outcome_text: str | Column) -> Column:
    """Causal query text of an episode: condition, response and outcome."""
    said = lambda s: trimmed(s["text"]) != ""
    line = lambda s: F.concat(s["text"], F.lit("\n"))
    conditions = F.filter(sources, lambda s: (s["role"] == "situation") & (s["actor_kind"] != "agent") & said(s))
    responses = F.filter(sources, lambda s: (s["role"] == "agent_act") & (s["actor_kind"] == "agent")
                         & (s["actor_ref"] == _col(agent)) & said(s))
    return F.concat(
        F.lit("USER_CONDITION\n"), F.array_join(F.transform(conditions, line), ""),
        F.lit("AGENT_RESPONSE\n"), F.array_join(F.transform(responses, line), ""),
        F.lit("USER_OUTCOME\n"), _col(outcome_text))


def condition_query(sources: Column) -> Column:
    said = F.filter(sources, lambda s: (s["role"] == "situation") & (s["actor_kind"] != "agent")
                    & (trimmed(s["text"]) != ""))
    return F.array_join(F.transform(said, lambda s: trimmed(s["text"])), "\n")
