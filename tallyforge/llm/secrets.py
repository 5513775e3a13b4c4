"""Secret scans in DataFrame functions alone.

Base patterns find assignments, access keys and hex strings. The method adds spans of kind
``entropy``: candidate strings of one character class over which some window's Shannon
entropy reaches that class's threshold. The counts of a window's characters are carried from one window
to the next: the character that leaves takes one off its count, the one that enters adds one, and
sum(c*log2(c)) moves by those two counts alone. An allow-list suppresses candidates; base spans always stay.

Null and empty text: no spans. Time grows with a text's length, also where it is one candidate
or holds very many spans. Spans that start at one place are ordered as kinds are listed (ties), ``entropy`` last.
Repeated rows each get their own result row. All columns pass through, whatever their names; the
one added is ``secret_spans``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import let, table

# Base patterns, each with the group whose length counts and its least length.
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
#: Strings that the entropy test looks at, and character classes: full match, characters, window length, least bits per character in some window. The first class that matches counts.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
CLASSES = {
    "hexadecimal": (r"^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdefABCDEF", 20, 3.0),
    "base64": (r"^(?=.*[0-9])(?=.*[A-Za-z])", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=", 20, 3.6),
}
#: Candidates that match one of these are not secrets: UUIDs, decimal numbers and dates, examples, plain alphabets.
ALLOWED = (
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^[0-9_+/-]+$",
    r"(?i)example|sample|dummy|placeholder|xxxxxx",
    r"(?i)0123456789|abcdefghij|qwertyuiop",
)
#: Nor are names and paths: words, capitals at their start and up to four digits at their end, parted by single marks. Such a string has a mark and none of these.
NAME_PARTS, NOT_A_NAME = r"[_/+-]", r"^[^A-Za-z]|[_/+-](?:[^A-Za-z]|$)|[A-Za-z0-9][A-Z]|[0-9][A-Za-z]|[0-9]{5}|="


def scan(items: Column, zero: Column, step: Callable[[Column, Column], tuple[Column, Column]], out: str) -> Column:
    """The array of step's results along items; step(state, item) gives (next state, result), results are of type out.

    It goes in blocks of the root of their number, as growing one array by one element takes time in its length.
    """
    empty = lambda kind: F.array().cast(f"array<{kind}>")

    def one(acc: Column, x: Column) -> Column:
        state, result = step(acc["state"], x)
        return F.struct(state.alias("state"), F.concat(acc["out"], F.array(result)).alias("out"))

    def block(acc: Column, part: Column) -> Column:
        inside = F.aggregate(part, F.struct(acc["state"].alias("state"), empty(out).alias("out")), one)
        return let(inside, lambda i: F.struct(i["state"].alias("state"), F.concat(acc["out"], F.array(i["out"])).alias("out")))

    def run(all_items: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(all_items))), F.lit(1)).cast("int")
        starts = F.when(F.size(all_items) > 0, F.sequence(F.lit(1), F.size(all_items), width)).otherwise(F.array().cast("array<int>"))
        blocks = F.transform(starts, lambda i: F.slice(all_items, i, width))
        return F.flatten(F.aggregate(blocks, F.struct(zero.alias("state"), empty(f"array<{out}>").alias("out")), block, lambda acc: acc["out"]))

    return let(items, run)


SPAN = "struct<s:int,e:int,m:string>"


def spans(text: Column, pattern: str) -> Column:
    """Array of (s: start, e: end, m: match), code points, end exclusive, of the leftmost matches that don't overlap."""

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        begin = at + F.length(x["gap"])
        end = begin + F.length(x["m"])
        return end, F.struct(begin.alias("s"), end.alias("e"), x["m"].alias("m"))

    def placed(found: Column) -> Column:
        pairs = F.zip_with(found, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), lambda m, gap: F.struct(m.alias("m"), gap.alias("gap")))
        return F.when(F.size(found) > 0, scan(pairs, F.lit(0), step, SPAN)).otherwise(F.array().cast(f"array<{SPAN}>"))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def _clog(count: Column) -> Column:
    return F.when(count > 1, count * F.log2(count.cast("double"))).otherwise(F.lit(0.0))


def window_entropy(text: Column, characters: str, width: int) -> Column:
    """The largest Shannon entropy, in bits per character, of text's windows of width characters; others than the given ones count as one.

    A text of fewer characters is one window; an empty one has entropy zero.
    """
    place = lambda c: F.instr(F.lit(characters), c)  # noqa: E731  0 for others

    def step(acc: Column, x: Column) -> Column:
        def moved(counts: Column) -> Column:
            at = lambda p: F.element_at(counts, p + 1)
            gone = F.when(x["leaves"].isNotNull(), at(x["leaves"])).otherwise(F.lit(0))
            there = at(x["enters"]) - F.when(x["leaves"] == x["enters"], 1).otherwise(0)
            now = acc["s"] - F.when(gone > 0, _clog(gone) - _clog(gone - 1)).otherwise(F.lit(0.0)) + _clog(there + 1) - _clog(there)
            size = F.least(acc["n"] + 1, F.lit(width))
            return F.struct(F.transform(counts, lambda n, k: n + F.when(k == x["enters"], 1).otherwise(0) - F.when(k == x["leaves"], 1).otherwise(0)).alias("counts"), now.alias("s"), size.alias("n"), F.greatest(acc["best"], F.when(x["ends"], F.log2(size.cast("double")) - now / size).otherwise(F.lit(0.0))).alias("best"))

        return moved(acc["counts"])

    def over(c: Column) -> Column:
        n = F.size(c)
        gone = F.slice(F.concat(F.array_repeat(F.lit(None).cast("int"), width), c), F.lit(1), n)
        moves = F.zip_with(F.transform(c, lambda p, i: F.struct(p.alias("p"), ((i + 1 >= width) | (i + 1 == n)).alias("ends"))), gone, lambda x, g: F.struct(x["p"].alias("enters"), g.alias("leaves"), x["ends"].alias("ends")))
        start = F.struct(F.array_repeat(F.lit(0), len(characters) + 1).alias("counts"), F.lit(0.0).alias("s"), F.lit(0).alias("n"), F.lit(0.0).alias("best"))
        return F.aggregate(moves, start, step, lambda acc: acc["best"])

    return let(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), place), over)


def find_secrets(docs: DataFrame, text: str = "text", base: dict = BASE, classes: dict = CLASSES, allowed: tuple = ALLOWED) -> DataFrame:
    """docs with a column ``secret_spans``: array of (kind, start, end), by start and then as kinds are listed.

    A candidate that overlaps a base span adds nothing. Runs without a shuffle.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    k = len(base)
    sure = F.concat(*(_base_spans(whole, i, kind, *base[kind]) for i, kind in enumerate(base)))
    both = F.array_sort(F.concat(sure, F.transform(spans(whole, CANDIDATE), lambda x: _span(x, k, "entropy"))))
    kept = let(both, lambda found: F.filter(_apart(found, k), lambda x: (x["k"] < k) | _secret(x["m"], classes, allowed)))
    return docs.withColumn("secret_spans", F.transform(kept, lambda x: F.struct(x["kind"], x["start"], x["end"])))


FOUND = "struct<start:int,k:int,kind:string,end:int,m:string>"


def _apart(found: Column, k: int) -> Column:
    """Sorted spans less those of kind k that overlap another kind's: one pass for base spans that begin before, one back for those after."""

    def before(reach: Column, x: Column) -> tuple[Column, Column]:
        own = x["k"] == k
        return F.when(own, reach).otherwise(F.greatest(reach, x["end"])), F.struct(x.alias("x"), (~own | (reach <= x["start"])).alias("good"))

    def after(least: Column, y: Column) -> tuple[Column, Column]:
        own = y["x"]["k"] == k
        return F.when(own, least).otherwise(y["x"]["start"]), F.struct(y["x"].alias("x"), (y["good"] & (~own | (least >= y["x"]["end"]))).alias("good"))

    marked = f"struct<x:{FOUND},good:boolean>"
    there = scan(found, F.lit(0), before, marked)
    back = F.reverse(scan(F.reverse(there), F.lit(2**31 - 1), after, marked))
    kept = F.transform(F.filter(back, lambda y: y["good"]), lambda y: y["x"])
    return F.when(F.exists(found, lambda x: x["k"] == k) & F.exists(found, lambda x: x["k"] < k), kept).otherwise(found)


def _span(x: Column, k: int, kind: str) -> Column:
    return F.struct(x["s"].alias("start"), F.lit(k).alias("k"), F.lit(kind).alias("kind"), x["e"].alias("end"), x["m"].alias("m"))


def _base_spans(text: Column, k: int, kind: str, pattern: str, group: int, least: int) -> Column:
    kept = F.filter(spans(text, pattern), lambda x: F.length(F.regexp_extract(x["m"], pattern, group)) >= least)
    return F.transform(kept, lambda x: _span(x, k, kind))


def _secret(m: Column, classes: dict, allowed: tuple) -> Column:
    """Whether a candidate is on no allow-list and has a dense window."""
    suppressed = m.rlike(NAME_PARTS) & ~m.rlike(NOT_A_NAME)
    for p in allowed:
        suppressed = suppressed | m.rlike(p)
    dense = F.lit(False)
    for full, characters, width, bits in reversed(classes.values()):
        dense = F.when(m.rlike(full), window_entropy(m, characters, width) >= bits).otherwise(dense)
    return ~suppressed & dense


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    docs = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secret_spans", lambda x: x["kind"] != "entropy")
    count = lambda kind: F.size(F.filter("secret_spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return docs.select(
        "doc_id", *(count(kind) for kind in BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secret_spans")).alias("spans"),
        F.size(F.filter("secret_spans", lambda x: x["kind"] == "entropy")).cast("long").alias("n_entropy"),
    )

