"""Text mining over comments: themes, polarity, demand groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.ranks import top_rows

# Letter runs of the two script modes, sizes of grams, and demand groups in the order they are tried.
RUNS = {"latin": "[a-z]+", "cjk": "[\\u4e00-\\u9fff]+"}
DEMAND = (("capacity", "size|big|small|large|fit"), ("price", "price|cost|cheap|much|pay"), ("link", "link|where|buy|shop"), ("gift", "gift|present|birthday"))
HOOKS = (("delivery", "show the packing"), ("broken", "show the packing"), ("size", "show it beside common things"), ("colour", "show it in daylight"), ("price", "show what is in the set"), ("clean", "show how it is cleaned"))


def grams(df: DataFrame, doc: str, text: str, script: str = "latin", sizes: tuple[int, int] = (2, 4), stops: str | Column = "") -> DataFrame:
    """(doc, term, n) of the character grams inside letter runs; counted within a document first."""
    runs = df.select(doc, F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(f"({RUNS[script]})"), F.lit(1))).alias("run"))
    sized = runs.select(doc, "run", F.explode(F.array(*(F.lit(n) for n in range(sizes[0], sizes[1] + 1)))).alias("size")).where("length(run) >= size")
    each = sized.select(doc, F.explode(F.transform(F.sequence(F.lit(1), F.length("run") - F.col("size") + 1), lambda i: F.substring(F.col("run"), i, F.col("size")))).alias("term"))
    if isinstance(stops, Column) or stops:
        stop = stops if isinstance(stops, Column) else F.lit(stops)
        each = each.where(~stop.contains(F.substring("term", 1, 1)) & ~stop.contains(F.substring("term", -1, 1)))
    return each.groupBy(doc, "term").agg(F.count("*").alias("n"))


def themes(df: DataFrame, doc: str, text: str, least_docs: int = 2, top: int = 10, **how) -> DataFrame:  # noqa: ANN003
    """Terms by count times coverage; a term inside a longer one with as many documents is dropped."""
    n_docs = df.where(F.trim(F.col(text)) != "").agg(F.countDistinct(doc).alias("n_docs"))
    kept = grams(df, doc, text, **how).groupBy("term").agg(F.sum("n").alias("count"), F.count("*").alias("doc_count")).where(f"doc_count >= {least_docs}")
    shorter = kept.select("doc_count", F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.length("term") - 1)), lambda n: F.transform(F.sequence(F.lit(1), F.length("term") - n + 1), lambda i: F.substring(F.col("term"), i, n)))))).alias("part"), "term").where("length(part) < length(term)")
    inside = shorter.select(F.col("part").alias("term"), "doc_count").distinct()
    free = kept.join(inside, ["term", "doc_count"], "left_anti").crossJoin(F.broadcast(n_docs))  # one row
    scored = free.select("term", "count", "doc_count", (F.col("doc_count") / F.col("n_docs")).alias("coverage"), (F.col("count") * F.col("doc_count") / F.col("n_docs")).alias("score"))
    return scored.orderBy(F.desc("score"), F.desc("count"), "term").limit(top)


def theme_periods(df: DataFrame, period: str, text: str, term: str) -> DataFrame:
    """Documents with the term in every period that has any."""
    return df.groupBy(period).agg(F.count_if(F.lower(F.col(text)).contains(term)).alias("doc_count"))


def theme_series(df: DataFrame, period: str, text: str, terms: tuple[str, ...]) -> DataFrame:
    """(term, period, doc_count) for every term and every period that has any text, zeros too; all terms in one pass."""
    has = [F.struct(F.lit(t).alias("term"), F.count_if(F.lower(F.col(text)).contains(t)).alias("doc_count")) for t in terms]
    return df.where(F.col(period).isNotNull()).groupBy(period).agg(F.array(*has).alias("_x")).select(period, F.inline("_x")).select("term", period, "doc_count")


def occurrences(text: Column, terms: tuple[str, ...]) -> Column:
    """Occurrences of the terms that don't overlap themselves, in all."""
    out: Column = F.lit(0)
    for t in terms:
        out = out + F.coalesce(F.regexp_count(text, F.lit(f"\\Q{t}\\E")), F.lit(0))
    return out


def polarity(text: Column, good: tuple[str, ...], bad: tuple[str, ...]) -> Column:
    """(good - bad) / (good + bad) over lexicon hits; 0 without any."""
    p, n = occurrences(text, good), occurrences(text, bad)
    return F.when(p + n > 0, (p - n) / (p + n)).otherwise(0.0)


def demand_group(text: Column) -> Column:
    out: Column = F.lit("other")
    for name, pattern in reversed(DEMAND):
        out = F.when(F.lower(text).rlike(pattern), name).otherwise(out)
    return out


def hook(theme: Column) -> Column:
    """The answer to an objection named in the theme, the longest name first; null if none is known."""
    out: Column = F.lit(None).cast("string")
    for name, answer in sorted(HOOKS, key=lambda x: len(x[0])):
        out = F.when(F.lower(theme).contains(name), answer).otherwise(out)
    return out


def demand_summary(df: DataFrame, doc: str, text: str) -> DataFrame:
    """Comments, documents, share and the first three examples of each demand group."""
    rows = df.withColumn("demand_group", demand_group(F.col(text)))
    s = rows.groupBy("demand_group").agg(F.count("*").alias("comments"), F.countDistinct(doc).alias("notes"))
    first = top_rows(rows, ["demand_group"], [F.asc(text), F.asc(doc)], 3).groupBy("demand_group").agg(F.sort_array(F.collect_list(text)).alias("examples"))
    total = rows.agg(F.count("*").alias("_n"))
    return s.join(first, "demand_group").crossJoin(F.broadcast(total)).select("demand_group", "comments", "notes", (F.col("comments") / F.col("_n")).alias("comment_share"), "examples")  # one row


def seed_themes(df: DataFrame, text: str, lexicon: dict[str, tuple[str, ...]], top: int = 10) -> DataFrame:
    """Themes of a fixed lexicon, for when too few texts repeat anything: hits and documents of each group, in one pass."""
    hits = F.array(*(F.struct(F.lit(g).alias("term"), occurrences(F.col(text), words).alias("hits")) for g, words in lexicon.items()))
    n_docs = df.where(F.trim(F.col(text)) != "").agg(F.count("*").alias("n_docs"))
    found = df.select(F.inline(hits)).where("hits > 0").groupBy("term").agg(F.sum("hits").alias("count"), F.count("*").alias("doc_count")).crossJoin(F.broadcast(n_docs))  # one row
    scored = found.select("term", "count", "doc_count", (F.col("doc_count") / F.col("n_docs")).alias("coverage"), (F.col("count") * F.col("doc_count") / F.col("n_docs")).alias("score"))
    return scored.orderBy(F.desc("score"), F.desc("count"), "term").limit(top)


def mean_polarity(df: DataFrame, keys: list[str], text: Column, good: tuple[str, ...], bad: tuple[str, ...]) -> DataFrame:
    """The mean polarity of texts that have any; 0 where none has."""
    rows = df.withColumn("_p", polarity(text, good, bad))
    return rows.groupBy(*keys).agg(F.coalesce(F.avg(F.when(F.col("_p") != 0, F.col("_p"))), F.lit(0.0)).alias("mean_polarity"))
