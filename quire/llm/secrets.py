"""Secret scans with DataFrame functions only.

Three fixed kinds of spans come from patterns (assignments, access keys, hex
runs). Entropy spans come from candidate strings: a window slides along each
candidate and the sum of ``c * log2(c)`` over its character counts is updated
by the counts of the one character that enters and the one that leaves. The
counts are kept in the fold's state, five bits a character, and the sum in
fixed point, so a step costs the same wherever it is and nothing drifts. Each
character class has its own entropy limit, and windows at or above it merge
into maximal spans. Entropy spans inside a pattern span are not repeated.

The allow-list has two parts. Whole candidates that are UUIDs, numbers, rules
or slugs are harmless. Words such as ``example`` clear only the part of a
candidate (between ``/ = _ -``) in which they stand: no window touches that
part, and the rest is scanned.

Positions are code points, end exclusive. They come from the pieces between
matches: split and extract-all give both sides, and running lengths give
starts. All steps are linear in the text or nearly so: arrays are bound before
lambdas read them, running results are made in blocks, and every pattern with
a repeated group is possessive, as others overflow the matcher's stack on long
runs. One scan, no shuffle, no join; every document is independent, so no key
can be hot.

Defined results for odd input: a null text is empty and has no spans; a null
``doc_id`` keeps its row; repeated rows are scanned one by one; an empty table
gives an empty result; extra columns are ignored by :func:`scan_secrets` and
returned unchanged by :func:`redact_secrets`. Whole texts are scanned.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.arrays import BLOCK, cut, let, running

#: Fixed patterns of the contract, in the order in which spans are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HEAD = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
#: A run that is long enough is the whole leftmost match, so the length
#: condition can be part of the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Character classes of scanned runs, narrowest first, with the window entropy
#: (bits per character) from which a window counts.
CLASSES = (
    (r"^[0-9a-fA-F]+$", 3.0),
    (r"^[A-Za-z]+$", 3.9),
    (r"^[A-Za-z0-9+/_=-]+$", 3.6),
)
#: Whole candidates that are left alone.
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # UUID
    r"^[0-9]+$",  # numbers
    r"^[+/_=-]+$",  # rules and separators
    r"^[a-z]+(?:[/_-][a-z]+)++$",  # paths and slugs
)
#: Words that clear the part of a candidate in which they stand.
ALLOW_WORDS = r"(?i)example|sample|dummy|placeholder|changeme|xxxx|abcdefgh|01234567|qwertyui"
SEPARATORS = "[/=_-]"

_SPAN = "array<struct<s:bigint,e:bigint>>"
#: Candidate characters lie from "+" to "z"; twelve counts of five bits a long.
_LOW, _WORDS, _BITS, _PER = 43, 7, 5, 12
_ONE = 1 << 40  # fixed point of the entropy sum


def _none() -> Column:
    return F.array().cast(_SPAN)


def match_spans(text: Column, pattern: str, found: Column) -> Column:
    """(s, e) of every match, from the matches and the pieces between them."""
    sizes = F.zip_with(F.split(text, pattern, -1), found, lambda g, m: F.struct(F.length(g).alias("gap"), F.coalesce(F.length(m), F.lit(0)).alias("n")))

    def placed(z: Column) -> Column:
        ends = running(F.transform(z, lambda x: x["gap"] + x["n"]), lambda a, b: a + b)
        spans = F.zip_with(ends, z, lambda e, x: F.struct((e - x["n"]).alias("s"), e.alias("e")))
        return F.filter(spans, lambda x: x["e"] > x["s"])  # the last piece has no match

    return let(sizes, placed)


def entropy_spans(string: Column, limit: Column, window: int) -> Column:
    """Maximal spans of one candidate whose windows reach ``limit`` bits.

    State of the fold: the counts of the window's characters, the sum of
    c*log2(c) over them, the span that is open and those before it. A step
    judges the window so far, then takes out the character that leaves and
    puts in the one that enters.
    """
    if not 2 <= window < 1 << _BITS:
        raise ValueError("the window must have 2 to 31 characters")
    gain = [round(_ONE * ((c + 1) * math.log2(c + 1) - (c * math.log2(c) if c else 0))) for c in range(window)]
    gains = F.array(*[F.lit(g).cast("long") for g in gain])
    count = lambda counts, c: F.call_function("shiftright", F.get(counts, c["word"]), c["place"]).bitwiseAND(F.lit((1 << _BITS) - 1)).cast("int")
    long = lambda x: F.lit(x).cast("long")

    pair = lambda s, e: F.array(F.struct(s.alias("s"), e.alias("e")))

    def judged(a: Column, limit: Column) -> tuple[Column, Column, Column]:
        """The open span and the closed ones, with the window that ends here."""
        bits = F.log2(F.lit(float(window))) - a["window"]["sum"] / (_ONE * float(window))
        hit = (a["at"] >= window) & (bits >= limit - 1e-9)
        fresh = hit & (a["e"] < a["at"] - window)
        closed = F.when(fresh & (a["s"] >= 0), F.concat(a["out"], pair(a["s"], a["e"]))).otherwise(a["out"])
        return F.when(fresh, a["at"] - window).otherwise(a["s"]), F.when(hit, a["at"]).otherwise(a["e"]), closed

    def moved(counts: Column, total: Column, old: Column, new: Column) -> Column:
        """Sum and counts after one character left and one entered."""
        filling = old["word"].isNull()
        lost = F.when(filling, long(0)).otherwise(F.get(gains, count(counts, old) - 1))
        same = F.when(old["one"] == new["one"], (old["word"] == new["word"]).cast("int")).otherwise(0)
        change = lambda x, k: x + F.when(k == new["word"], new["one"]).otherwise(long(0)) - F.when(k == old["word"], old["one"]).otherwise(long(0))
        return F.struct((total - lost + F.get(gains, count(counts, new) - same)).alias("sum"), F.transform(counts, change).alias("counts"))

    def scan(codes: Column, limit: Column) -> Column:
        empty = F.struct(long(0).alias("sum"), F.array(*[long(0)] * _WORDS).alias("counts"))
        start = F.struct(long(0).alias("at"), empty.alias("window"), long(-1).alias("s"), long(-1).alias("e"), _none().alias("out"))

        def step(a: Column, new: Column) -> Column:
            s, e, out = judged(a, limit)
            old = F.get(codes, (a["at"] - window).cast("int"))  # null while the window fills
            after = moved(a["window"]["counts"], a["window"]["sum"], old, new)
            return F.struct((a["at"] + 1).alias("at"), after.alias("window"), s.alias("s"), e.alias("e"), out.alias("out"))

        def block(a: Column, first: Column) -> Column:
            """A block of characters: the state is copied at every step, so
            closed spans join those of earlier blocks only at its end."""
            fresh = F.struct(*[a[c].alias(c) for c in ("at", "window", "s", "e")], _none().alias("out"))
            inner = F.aggregate(F.slice(codes, first, BLOCK), fresh, step)
            joined = lambda r: F.struct(*[r[c].alias(c) for c in ("at", "window", "s", "e")], F.concat(a["out"], r["out"]).alias("out"))
            return let(inner, joined)

        def last(a: Column) -> Column:
            s, e, out = judged(a, limit)
            return F.when(s >= 0, F.concat(out, pair(s, e))).otherwise(out)

        return F.aggregate(F.sequence(F.lit(1), F.size(codes), F.lit(BLOCK)), start, block, last)

    # where the count of a character is: the long, the bits in it, a one there
    spots = F.array(*[F.struct(F.lit(c // _PER).alias("word"), F.lit(c % _PER * _BITS).alias("place"), long(1 << c % _PER * _BITS).alias("one")) for c in range(_WORDS * _PER)])
    codes = F.transform(F.slice(F.split(string, ""), 1, F.length(string)), lambda c: F.get(spots, F.ascii(c) - _LOW))
    return let(limit, lambda v: let(codes, lambda c: scan(c, v)))


def _cleared(string: Column, words: str) -> Column:
    """A candidate with the parts that hold an allowed word blanked out."""

    def blank(marks: Column) -> Column:
        part = lambda p, i: F.concat(F.when(p.rlike(words), F.repeat(F.lit(" "), F.length(p))).otherwise(p), F.coalesce(F.get(marks, i), F.lit("")))
        return F.array_join(F.transform(F.split(string, SEPARATORS, -1), part), "")

    return F.when(string.rlike(words), let(F.regexp_extract_all(string, F.lit(SEPARATORS), 0), blank)).otherwise(string)


def find_secrets(text: Column, window: int = 20, allow: tuple = ALLOW, allow_words: str = ALLOW_WORDS) -> dict[str, Column]:
    """Span columns of one text column, by kind."""
    assign = match_spans(text, ASSIGN, F.regexp_extract_all(text, F.lit(ASSIGN), 0))
    values = F.regexp_extract_all(text, F.lit(ASSIGN), 2)
    long_enough = F.zip_with(assign, values, lambda x, v: F.when(F.length(v) >= 6, x))
    by_pattern = lambda p: match_spans(text, p, F.regexp_extract_all(text, F.lit(p), 0))
    limit = lambda s: F.coalesce(*[F.when(s.rlike(p), F.lit(v)) for p, v in CLASSES])

    def of_run(s: Column, at: Column) -> Column:
        return F.transform(entropy_spans(s, limit(s), window), lambda x: F.struct((x["s"] + at).alias("s"), (x["e"] + at).alias("e")))

    def of_candidate(s: Column, at: Column) -> Column:
        def runs(clear: Column) -> Column:
            def each(found: Column) -> Column:
                both = F.arrays_zip(match_spans(clear, CANDIDATE, found).alias("p"), found.alias("v"))
                return F.flatten(F.transform(both, lambda z: of_run(z["v"], z["p"]["s"] + at)))

            return let(F.regexp_extract_all(clear, F.lit(CANDIDATE), 0), each)

        allowed = F.lit(False)
        for p in allow:
            allowed = allowed | s.rlike(p)
        return F.when(allowed, _none()).otherwise(let(_cleared(s, allow_words), runs))

    def all_runs(strings: Column) -> Column:
        both = F.arrays_zip(match_spans(text, CANDIDATE, strings).alias("p"), strings.alias("v"))
        return F.flatten(F.transform(both, lambda z: of_candidate(z["v"], z["p"]["s"])))

    return {
        "assign": F.when(text.rlike(ASSIGN_HEAD), F.filter(long_enough, lambda x: x.isNotNull())).otherwise(_none()),
        "access": F.when(F.contains(text, F.lit("AKIA")), by_pattern(ACCESS)).otherwise(_none()),
        "hex": F.when(text.rlike(HEX), by_pattern(HEX)).otherwise(_none()),
        "entropy": F.when(text.rlike(CANDIDATE), let(F.regexp_extract_all(text, F.lit(CANDIDATE), 0), all_runs)).otherwise(_none()),
    }


def _listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))))


def with_spans(docs: DataFrame, text: Column, window: int = 20, allow: tuple = ALLOW, allow_words: str = ALLOW_WORDS) -> DataFrame:
    """Add ``_base`` and ``_spans``: (s, no, kind, e) sorted by start, then by
    kind as listed in ``KINDS``."""
    for kind, col in find_secrets(text, window, allow, allow_words).items():
        docs = docs.withColumn(f"_{kind}", col)
    tagged = lambda k: F.transform(
        F.col(f"_{k}"), lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(k)).alias("no"), F.lit(k).alias("kind"), x["e"].alias("e"))
    )
    docs = docs.withColumn("_base", F.array_sort(F.concat(*[tagged(k) for k in KINDS[:3]])))

    def outside(z: Column) -> Column:
        """All spans in order, without entropy spans that end before the
        furthest end of the pattern spans that start no later."""
        reach = running(F.transform(z, lambda x: F.when(x["no"] < 3, x["e"]).otherwise(-1)), F.greatest)
        kept = F.zip_with(z, reach, lambda x, r: F.when((x["no"] < 3) | (r < x["e"]), x))
        return F.filter(kept, lambda x: x.isNotNull())

    every = let(F.array_sort(F.concat("_base", tagged("entropy"))), outside)
    return docs.withColumn("_spans", F.when(F.size("_entropy") > 0, every).otherwise(F.col("_base")))


def scan_secrets(docs: DataFrame, window: int = 20, allow: tuple = ALLOW, allow_words: str = ALLOW_WORDS) -> DataFrame:
    """One row per document: doc_id, counts per kind, base_sha256 (digest of
    the pattern spans) and all spans as ``kind:start:end`` text."""
    d = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    d = with_spans(d, F.col("_text"), window, allow, allow_words)
    count = lambda k: F.size(f"_{k}").cast("long")
    return d.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(_listed(F.col("_base")), 256).alias("base_sha256"),
        _listed(F.col("_spans")).alias("spans"),
        (F.size("_spans") - F.size("_base")).cast("long").alias("n_entropy"),
    )


def _masked(text: Column, spans: Column, mask: str) -> Column:
    """The text with the union of its sorted spans replaced. A span starts a
    new stretch if it begins after all earlier ends; a stretch ends at the
    furthest end before the next one."""

    def over(z: Column) -> Column:
        return let(running(F.transform(z, lambda x: x["e"]), F.greatest), lambda reach: borders(z, reach))

    def borders(z: Column, reach: Column) -> Column:
        starts = F.transform(z, lambda x, i: F.when((i == 0) | (F.get(reach, i - 1) < x["s"]), F.struct(x["s"].alias("s"), i.alias("i"))))

        def pairs(first: Column) -> Column:
            end = lambda x, k: F.get(reach, F.coalesce(F.get(first, k + 1)["i"], F.size(z)) - 1)
            return F.flatten(F.transform(first, lambda x, k: F.array(x["s"], end(x, k))))

        return let(F.filter(starts, lambda x: x.isNotNull()), pairs)

    at = F.concat(F.array(F.lit(0).cast("long")), let(spans, over), F.array(F.length(text).cast("long")))
    pieces = cut(text, at)  # kept, masked, kept, ...
    return F.array_join(F.filter(pieces, lambda x, i: i % 2 == 0), mask)


def redact_secrets(docs: DataFrame, mask: str = "[SECRET]", window: int = 20, allow: tuple = ALLOW, allow_words: str = ALLOW_WORDS) -> DataFrame:
    """``docs`` with every span of its text replaced by ``mask``; overlapping
    spans are one. All other columns stay, but ``n_chars`` follows the text."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    row = with_spans(row.withColumn("_text", F.coalesce(F.col("_row.text"), F.lit(""))), F.col("_text"), window, allow, allow_words)
    row = row.withColumn("_new", F.when(F.size("_spans") > 0, _masked(F.col("_text"), F.col("_spans"), mask)))
    out = {c: F.col("_row")[c] for c in docs.columns}
    out["text"] = F.coalesce("_new", F.col("_row.text"))
    if "n_chars" in out:
        out["n_chars"] = F.coalesce(F.length("_new").cast(dict(docs.dtypes)["n_chars"]), F.col("_row.n_chars"))
    return row.select(*[v.alias(c) for c, v in out.items()])
