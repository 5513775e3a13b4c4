"""Fill-in-the-middle forms of whole texts.

A text is a row of units: runs of letters A-Z and a-z, and single other characters. It is cut into blocks
of BLOCK code points; a Fenwick tree holds, for each block, the units that begin in it and its code points.
A cut before the u-th unit is found by descending the tree by powers of two to the block that the unit
begins in; only that block is looked at again. A run of letters over several blocks begins in the first.

Null text is empty and plain, as is any text that holds a marker. A null id hashes as an empty one. Texts of any
length are cut whole, with memory in proportion to the text. Equal cuts (ties) give an empty middle. Repeated rows each get
their own result row; an empty table gives an empty result. Other columns pass through; one named as the result is replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import table

BLOCK, SEED = 4096, "1"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts, about so many are transformed, and of 100 of these so many have their suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20
RESULT = "struct<text:string,form:string,n:bigint,prefix_chars:bigint,middle_chars:bigint>"


def beginnings(block: str, inside: bool) -> np.ndarray:
    """Whether a unit begins at each code point of block; inside: the code point before it is a letter."""
    points = np.frombuffer(block.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = (points | 32) - np.uint32(97) < 26
    before = np.concatenate(([inside], letter[:-1]))
    return ~(letter & before)


def is_letter(c: str) -> bool:
    return c.isascii() and c.isalpha()


class Units:
    """A text's units and code points by block, as two Fenwick trees."""

    def __init__(self, text: str, size: int = BLOCK):
        self.text, self.size = text, size
        self.blocks = -(-len(text) // size)
        self.units, self.points = [0] * (self.blocks + 1), [0] * (self.blocks + 1)
        self.n = 0
        for b in range(1, self.blocks + 1):
            found = int(np.count_nonzero(self._begin(b)))
            self.n += found
            self.units[b] += found
            self.points[b] += min(size, len(text) - (b - 1) * size)
            above = b + (b & -b)
            if above <= self.blocks:
                self.units[above] += self.units[b]
                self.points[above] += self.points[b]

    def _begin(self, b: int) -> np.ndarray:
        """Of the b-th block, from 1."""
        start = (b - 1) * self.size
        return beginnings(self.text[start : start + self.size], start > 0 and is_letter(self.text[start - 1]))

    def place(self, unit: int) -> int:
        """Code points before the unit with that number, from 0; all of them for the number of units."""
        at, before, left = 0, 0, unit
        step = 1 << self.blocks.bit_length()
        while step := step >> 1:
            if at + step <= self.blocks and self.units[at + step] <= left:
                at += step
                left -= self.units[at]
                before += self.points[at]
        if at == self.blocks:
            return before
        return before + int(np.flatnonzero(self._begin(at + 1))[left])


def cut(key: str, text: str, transformed: int, suffix_first: int, size: int = BLOCK) -> tuple[str, str, int, int | None, int | None]:
    """(output, form, units, code points of the prefix, of the middle)."""
    units = Units(text, size)
    digest = hashlib.sha256(f"{SEED}:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or h3 % 100 >= transformed or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return text, "plain", units.n, None, None
    a, b = (units.place(u) for u in sorted((h1 % (units.n + 1), h2 % (units.n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < suffix_first:
        return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}", "spm", units.n, a, b - a
    return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}", "psm", units.n, a, b - a


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = "fim", transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """docs with a struct of the output text, its form, units and the code points of prefix and middle (see RESULT)."""
    names = [f.split(":")[0] for f in RESULT[7:-1].split(",")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

    @F.arrow_udf(RESULT)
    def forms(keys: pa.Array, texts: pa.Array) -> pa.Array:
        rows = [cut(k.as_py() or "", t.as_py() or "", transformed, suffix_first) for k, t in zip(keys, texts, strict=True)]
        columns = zip(*rows, strict=True) if rows else [()] * len(names)
        return pa.StructArray.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names)

    return docs.withColumn(name, forms(F.col(key).cast("string"), F.col(text).cast("string")))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. A text with markers is plain, so that an output has none but its own."""
    part = F.split(output, "<[PSM]>", -1)
    psm = F.concat(part[1], part[3], part[2])
    spm = F.concat(part[2], part[3], part[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_fim(spark, sf_dir: str) -> DataFrame:
    got = transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    out, form = F.col("fim.text"), F.col("fim.form")
    return got.select(
        "doc_id", F.col("fim.n").alias("n"), form.alias("form"), F.col("fim.prefix_chars").alias("prefix_chars"), F.col("fim.middle_chars").alias("middle_chars"),
        F.sha2(out, 256).alias("output_sha256"), F.sha2(restored(out, form), 256).alias("restored_sha256"),
    )


SQL = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
 k AS (SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM t),
 f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
 c AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m,
    coalesce(array_to_string(u[b + 1:], ''), '') AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM c"""
