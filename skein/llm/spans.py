"""Long exact spans shared between records (problem 10): paragraph MinHash banding.

The paragraphs of a text are all its runs of ``SPAN`` characters.  A paragraph's shingles are its runs of
``GRAM`` characters and its signature is the shingle of least hash (ties: the last).  One band of one row has
full recall here, since equal paragraphs have equal signatures; neighbouring paragraphs mostly share theirs, so
a text has about one signature in 50 characters.  The texts are read twice and never moved:

* the first pass writes the class (MD5) of each text and its signatures.  Signatures of two different classes or more
  are marked in two bitmaps of 2^26 bits, one for those of at most ``FEW`` texts, one for the more frequent ones;
  bitmaps have that size whatever the data's, so they may be broadcast;
* the second pass hands over what verifies the marked signatures.  For a signature of few texts that is the text round
  it, which is compared character by character, two by two.  For a frequent one these would be too many pairs without
  a result, so its whole paragraphs are brought together by the MD5 of their characters, as whole texts are.

A signature marked by chance does no harm: its contexts find no partner, or its paragraphs are equal or not.

Equal texts are one class from the start, and a task hands over a class once.  Frequent paragraphs pair classes only
at the first paragraph of a common run: where two classes have the same paragraph and their preceding paragraphs are
the same too, the pair is left to these.  A passage shared by many records so makes one row a pair, as the result
asks, and a frequent signature without a common paragraph makes none.

Texts are compared exactly as stored, by code points.  Texts that are null or shorter than ``SPAN`` share
nothing.  Empty input gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.components import components
from skein.runtime import cut, ship, table

#: Characters of a paragraph and of a shingle; texts of a signature that are compared two by two.
SPAN, GRAM, FEW = 200, 100, 16
#: Characters of the texts that are hashed in one go.
TOGETHER = 200_000


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads neighbouring values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(codes: np.ndarray, width: int, seed: int) -> np.ndarray:
    """64-bit hashes of all runs of ``width`` characters, a polynomial in mixed characters, mixed again."""
    n = len(codes)
    base, inverse = _BASES[seed]
    powers = _powers(base, n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_mix(codes + np.uint64(seed << 32)) * powers[:n], out=sums[1:])
    return _mix((sums[width:] - sums[:-width]) * _powers(inverse, n)[: n - width + 1])


_BASES = {1: (0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64))}
_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if len(_tables.get(base, ())) < n:
        size = 1 << max(12, n.bit_length())
        x = np.full(size, base, np.uint64)
        x[0] = 1
        _tables[base] = np.cumprod(x)
    return _tables[base]


def signatures(codes: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(place of the signature of each paragraph, hashes of all shingles).

    Shingles are ranked by the upper half of their hash, equal ones by place, the last first: both depend on the
    paragraph alone.
    """
    h = rolling(codes, gram, 1)
    w = span - gram + 1
    n = len(h) - w + 1
    low = np.uint64(0xFFFFFFFF)
    # sliding minimum of blocks: the least of the rest of one block and the begin of the next
    pad = -(-len(h) // w) * w
    x = np.full(pad, np.uint64(0xFFFFFFFFFFFFFFFF))
    x[: len(h)] = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))
    blocks = x.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[:n], ahead[w - 1 : w - 1 + n])
    return (low - (least & low)).astype(np.int64), h


def _together(texts: list[str], chars: int) -> Iterator[list[str]]:
    """The texts in lists of about so many characters."""
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


class Signed:
    """Signatures of several texts, none shorter than ``span``, found in one go: for every paragraph that lies in one
    text its ``text``, ``start`` and the ``place`` of its signature in that text, and the signature's ``hash``."""

    def __init__(self, texts: list[str], span: int, gram: int) -> None:
        ends = np.cumsum([len(t) for t in texts])
        place, h = signatures(_codes("".join(texts)), span, gram)
        at = np.arange(len(place))
        of = np.searchsorted(ends, at, side="right")
        inside = at + span <= ends[of]
        self.text, begin = of[inside], (ends - [len(t) for t in texts])[of[inside]]
        self.start, self.place, self.hash = at[inside] - begin, place[inside] - begin, h[place[inside]]
        new = np.ones(len(self.text), bool)
        new[1:] = (self.text[1:] != self.text[:-1]) | (self.place[1:] != self.place[:-1])
        #: The paragraphs that are the first with their signature.
        self.first = np.flatnonzero(new)


def _class(text: str) -> bytes:
    return hashlib.md5(text.encode()).digest()


def _signed(span: int, gram: int):
    """(doc_id, cls, c1, c2, n_chars, hs): c1 and c2 are the halves of cls, hs the signatures of a text."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            if not texts:
                continue
            hs, sizes = [], []
            for part in _together(texts, TOGETHER):
                x = Signed(part, span, gram)
                hs.append(x.hash[x.first].view(np.int64))
                sizes.append(np.bincount(x.text[x.first], minlength=len(part)))
            classes = [_class(t) for t in texts]
            halves = np.frombuffer(b"".join(classes), np.int64).reshape(-1, 2)
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(hs)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(classes, pa.binary()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array([len(t) for t in texts], pa.int32()), lists], ["doc_id", "cls", "c1", "c2", "n_chars", "hs"])

    return sign


def _bitmap(h: DataFrame) -> np.ndarray:
    """A bitmap of 2^26 bits with one set for each h; at most 2^20 words come to the driver."""
    words = h.select(F.expr("int(shiftright(h, 44) & 1048575)").alias("word"), F.expr("shiftleft(1L, int(shiftright(h, 38) & 63))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << 20, np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def _marked(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    word, bit = (h >> np.uint64(44)) & np.uint64((1 << 20) - 1), (h >> np.uint64(38)) & np.uint64(63)
    return (bitmap[word.astype(np.int64)] >> bit) & np.uint64(1) == 1


def _verified(span: int, gram: int, bitmaps):
    """Contexts of the signatures marked in the first bitmap, paragraphs of those in the second."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare, frequent = bitmaps.value
        seen: set[bytes] = set()
        for batch in batches:
            new = []
            for text in batch.column(0).to_pylist():
                key = _class(text)
                if key not in seen:
                    seen.add(key)
                    new.append(text)
            for part in _together(new, TOGETHER):
                x, keys = Signed(part, span, gram), [_class(t) for t in part]
                few = x.first[_marked(rare, x.hash[x.first])]
                if len(few):
                    cls, before, after = [], [], []
                    for i, p in zip(x.text[few].tolist(), x.place[few].tolist()):
                        text = part[i]
                        cls.append(keys[i])
                        before.append(text[max(p - span + gram, 0) : p][::-1])
                        after.append(text[p : p + span])
                    none = pa.nulls(len(few), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cls, pa.binary()), pa.array(x.place[few].astype(np.int32)), pa.array(x.hash[few].view(np.int64)), none, none, pa.array(before, pa.string()), pa.array(after, pa.string())], _COLUMNS
                    )
                many = np.flatnonzero(_marked(frequent, x.hash))
                if len(many):
                    whole, own, before = {}, [], []
                    for i, p in zip(x.text[many].tolist(), x.start[many].tolist()):
                        if i not in whole:
                            whole = {i: (memoryview(part[i].encode("utf-32-le")), {})}
                        chars, known = whole[i]
                        for at in (p, max(p - 1, 0)):
                            if at not in known:
                                known[at] = hashlib.md5(chars[4 * at : 4 * (at + span)]).digest()
                        own.append(known[p])
                        before.append(known[max(p - 1, 0)])
                    halves = lambda digests: np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                    mine, none = halves(own), pa.nulls(len(many), pa.string())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([keys[i] for i in x.text[many].tolist()], pa.binary()), pa.array(x.start[many].astype(np.int32)), pa.array(mine[:, 0]), pa.array(mine[:, 1]), pa.array(halves(before)[:, 0], mask=x.start[many] == 0), none, none], _COLUMNS
                    )

    return verify


_COLUMNS = ["cls", "start", "h1", "h2", "before", "left", "right"]


def common_prefix(a: str, b: str, most: int) -> Column:
    """Characters that two string columns have in common from their begin, up to ``most``, by halving."""
    steps = [1 << i for i in reversed(range(most.bit_length()))]
    longer = lambda n, s: F.when((n + s <= F.least(F.length(a), F.length(b))) & (F.substr(a, F.lit(1), n + s) == F.substr(b, F.lit(1), n + s)), n + s).otherwise(n)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), longer)


class Shared:
    """What texts share: ``members`` (cls, doc_id, n_chars) of the classes of equal texts, ``few`` pairs of classes
    (cls1, start1, cls2, start2, r, l) by a signature of at most ``FEW`` texts, ``many`` (cls, start, h1, h2, before)
    the paragraphs of more frequent signatures with their MD5 in halves."""

    def __init__(self, docs: DataFrame, doc_id: str, text: str, span: int = SPAN, gram: int = GRAM, few: int = FEW) -> None:
        spark = docs.sparkSession
        ship(spark)
        self.span, self.gram = span, gram
        texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null").where(F.length("text") >= span)
        signed = cut(texts.mapInArrow(_signed(span, gram), f"doc_id {dict(texts.dtypes)['doc_id']}, cls binary, c1 bigint, c2 bigint, n_chars int, hs array<bigint>"))
        self.members = signed.select("cls", "doc_id", "n_chars")
        ends = [f(c).alias(f"{c}_{n}") for c in ("c1", "c2") for f, n in ((F.min, "lo"), (F.max, "hi"))]
        several = cut(signed.select(F.explode("hs").alias("h"), "c1", "c2").groupBy("h").agg(*ends, F.count("*").alias("n")).where("c1_lo <> c1_hi or c2_lo <> c2_hi").select("h", (F.col("n") <= few).alias("few")))
        bitmaps = spark.sparkContext.broadcast((_bitmap(several.where("few")), _bitmap(several.where("not few"))))
        kinds = "cls binary, start int, h1 bigint, h2 bigint, before bigint, left string, right string"
        rows = cut(texts.select("text").mapInArrow(_verified(span, gram, bitmaps), kinds))
        # a class may come from several tasks; all rows of a signature are brought together once, for this and the join
        contexts = rows.where("right is not null").select("cls", "start", "h1", "left", "right").repartition("h1").dropDuplicates(["h1", "cls", "start"])
        self.few = self._compared(contexts.join(several.where("few").select(F.col("h").alias("h1")), "h1", "left_semi"))
        self.many = rows.where("right is null").select("cls", "start", "h1", "h2", "before").distinct()

    def _compared(self, rows: DataFrame) -> DataFrame:
        """Pairs of places of one signature with a common span: ``l`` characters before and ``r`` from the place on."""
        side = lambda i: rows.select("h1", *[F.col(c).alias(f"{c}{i}") for c in ("cls", "start", "left", "right")])
        pairs = side(1).join(side(2), "h1").where("cls1 < cls2")
        r, l = common_prefix("right1", "right2", 2 * self.span), common_prefix("left1", "left2", self.span)
        return pairs.select("cls1", "start1", "cls2", "start2", r.alias("r"), l.alias("l")).where((F.col("r") >= self.gram) & (F.col("l") + F.col("r") >= self.span))

    def class_pairs(self) -> DataFrame:
        """(cls1, cls2) of different classes with a common paragraph."""
        key = ["h1", "h2"]
        starts = self.many.groupBy(*key).agg(F.min("cls").alias("a"), F.max("cls").alias("b"), F.count("*").alias("n"), F.count("before").alias("inner"), F.min("before").alias("lo"), F.max("before").alias("hi"))
        p = self.many.join(starts.where("a <> b and (inner < n or lo <> hi)").select(*key), key).select(*key, "before", "cls").distinct()
        left, right = p.select(*key, F.col("before").alias("before1"), F.col("cls").alias("cls1")), p.select(*key, F.col("before").alias("before2"), F.col("cls").alias("cls2"))
        met = left.join(right, key).where("cls1 < cls2 and (before1 is null or before2 is null or before1 <> before2)")
        return met.select("cls1", "cls2").unionByName(self.few.select("cls1", "cls2")).distinct()

    def covered(self) -> DataFrame:
        """(cls, covered): characters of each class that other classes hold too, by the union of its intervals."""
        common = self.many.groupBy("h1", "h2").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).where("a <> b").select("h1", "h2")
        spans = self.many.join(common, ["h1", "h2"]).select("cls", F.col("start").alias("lo"), (F.col("start") + self.span).alias("hi"))
        for i in (1, 2):
            spans = spans.unionByName(self.few.select(F.col(f"cls{i}").alias("cls"), (F.col(f"start{i}") - F.col("l")).alias("lo"), (F.col(f"start{i}") + F.col("r")).alias("hi")))
        once = spans.groupBy("cls", "lo").agg(F.max("hi").alias("hi"))
        upto = F.max("hi").over(Window.partitionBy("cls").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1))
        return once.select("cls", F.greatest(F.lit(0), F.col("hi") - F.greatest("lo", F.coalesce(upto, F.lit(0)))).alias("gain")).groupBy("cls").agg(F.sum("gain").alias("covered"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    shared = Shared(table(spark, d, "documents"), "doc_id", "text")
    one, two = (shared.members.select(F.col("cls").alias(f"cls{i}"), F.col("doc_id").alias(c)) for i, c in ((1, "x"), (2, "y")))
    across = shared.class_pairs().join(one, "cls1").join(two, "cls2").select(F.least("x", "y").alias("doc_id1"), F.greatest("x", "y").alias("doc_id2"))
    copies = one.join(two, F.col("cls1") == F.col("cls2")).where("x < y").select(F.col("x").alias("doc_id1"), F.col("y").alias("doc_id2"))
    return across.unionByName(copies)


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    """For every document with shared passages: its characters, how many of them other documents hold too, and
    the smallest doc_id of the documents it is connected to by shared passages."""
    shared = Shared(table(spark, d, "documents"), "doc_id", "text")
    classes = shared.members.groupBy("cls").agg(F.count("*").alias("copies"), F.min("doc_id").alias("rep"))
    links = shared.class_pairs().join(classes.select(F.col("cls").alias("cls1"), F.col("rep").alias("r1")), "cls1").join(classes.select(F.col("cls").alias("cls2"), F.col("rep").alias("r2")), "cls2").select("r1", "r2")
    group = components(links, "r1", "r2").select(F.col("vertex").alias("rep"), "component")
    whole = classes.join(shared.covered(), "cls", "left").join(group, "rep", "left").where("copies > 1 or covered is not null").select("cls", "copies", "covered", F.coalesce("component", "rep").alias("grp"))
    return shared.members.join(whole, "cls").select("doc_id", F.col("n_chars").cast("bigint").alias("n_chars"), F.when(F.col("copies") > 1, F.col("n_chars")).otherwise(F.col("covered")).cast("bigint").alias("shared_chars"), "grp")


QUERIES = {"p10_found": p10_found, "p10_shares": p10_shares}
_WITH = """with recursive w as (select doc_id, len(text) n, s, substr(text, s, 200) p from (select doc_id, text, unnest(range(1, len(text) - 198)) s from documents where len(text) >= 200)),
  sh as (select p from w group by p having count(distinct doc_id) > 1), x as (select * from w semi join sh using (p)),
  f as (select distinct a.doc_id doc_id1, b.doc_id doc_id2 from x a join x b on a.p = b.p and a.doc_id < b.doc_id)"""
SQL = {
    "p10_found": f"{_WITH} select doc_id1, doc_id2 from f",
    "p10_shares": f"""{_WITH}, e as (select doc_id1 a, doc_id2 b from f union select doc_id2, doc_id1 from f),
  walk as (select distinct a w, a g from e union select e.b, walk.g from walk join e on e.a = walk.w), grp as (select w, min(g) g from walk group by w),
  c as (select doc_id, any_value(n) n, sum(least(200, coalesce(nx - s, 200))) covered from (select distinct doc_id, n, s, lead(s) over (partition by doc_id order by s) nx from (select distinct doc_id, n, s from x)) group by 1)
select c.doc_id, n::bigint n_chars, covered::bigint shared_chars, g grp from c join grp on grp.w = c.doc_id""",
}
