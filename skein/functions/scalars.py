"""Scalar expressions of the data model, all built from Spark's own functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.config import SETTINGS


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- keys


def digest(text: Column | str) -> Column:
    """32-bit key of a text: its MD5 folded by XOR of the four 32-bit words; null for null."""
    return _fold(F.md5(col(text)))


def digests(words: Column | str) -> Column:
    """Keys of the words of an array; each MD5 is taken once."""
    return F.transform(F.transform(col(words), F.md5), _fold)


def _fold(h: Column) -> Column:
    return reduce(lambda a, b: a.bitwiseXOR(b), (F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)))


def digest_large(text: Column | str) -> Column:
    """128-bit key of a text as a decimal string, by long division of the MD5's 32-bit words.

    2^128 has 39 digits, one more than Spark's decimals, so the number is divided by 10^9 again and again; the
    remainders are its digits by nine, the last first.
    """
    words = F.array(*(F.conv(F.substring(F.md5(col(text)), 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)))
    base = F.lit(10**9).cast("bigint")

    def divide(state: Column, word: Column) -> Column:
        x = state["rest"] * F.lit(1 << 32) + word
        return F.struct(F.concat(state["quotient"], F.array(F.call_function("div", x, base))).alias("quotient"), F.pmod(x, base).alias("rest"))

    def step(state: Column, _: Column) -> Column:
        start = F.struct(F.array().cast("array<bigint>").alias("quotient"), F.lit(0).cast("bigint").alias("rest"))
        done = F.aggregate(state["number"], start, divide)
        return F.struct(done["quotient"].alias("number"), F.concat(F.lpad(done["rest"].cast("string"), 9, "0"), state["digits"]).alias("digits"))

    first = F.struct(words.alias("number"), F.lit("").alias("digits"))
    digits = F.aggregate(F.sequence(F.lit(1), F.lit(5)), first, step)["digits"]
    return F.when(col(text).isNotNull(), F.regexp_replace(digits, "^0+(?=.)", ""))


# ---- time


def tenminute(created_at: Column | str) -> Column:
    """First 11 digits of yyyyMMddHHmmss: the ten-minute bucket."""
    return F.floor(col(created_at) / 1000).cast("bigint")


def hour(created_at: Column | str) -> Column:
    return F.floor(col(created_at) / 10_000).cast("bigint")


def day(created_at: Column | str) -> Column:
    return F.floor(col(created_at) / 1_000_000).cast("bigint")


def to_time(digits: Column | str) -> Column:
    """Timestamp of a yyyyMMddHHmmss number; null if it is none."""
    return F.try_to_timestamp(col(digits).cast("string"), F.lit("yyyyMMddHHmmss"))


def to_digits(ts: Column | str) -> Column:
    return F.date_format(col(ts), "yyyyMMddHHmmss").cast("bigint")


def feed_time(text: Column | str) -> Column:
    """Time of a feed message such as ``Wed Aug 27 13:08:45 +0000 2008``; the weekday is not looked at."""
    return F.try_to_timestamp(F.substring(col(text), 5, 40), F.lit("MMM dd HH:mm:ss Z yyyy"))


def bound(digits: Column | str, width: int = 11) -> Column:
    """A time typed with fewer digits, filled with zeros to the bucket's width."""
    return F.rpad(F.trim(col(digits).cast("string")), width, "0").cast("bigint")


def time_bounds(a: Column | str, b: Column | str) -> tuple[Column, Column]:
    """Both bounds filled, the smaller first."""
    x, y = bound(a), bound(b)
    return F.least(x, y), F.greatest(x, y)


def utc(ts: Column | str, zone: str) -> Column:
    return F.to_utc_timestamp(col(ts), zone)


def local(ts: Column | str, zone: str) -> Column:
    return F.from_utc_timestamp(col(ts), zone)


def recent_days(now: Column, n: int) -> Column:
    """The last n days up to ``now``, newest first, as yyyyMMdd numbers."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.date_format(F.date_sub(now.cast("date"), i), "yyyyMMdd").cast("bigint"))


# ---- text


def has_cyrillic(text: Column | str, letters: int = 1, whole: bool = False) -> Column:
    """At least so many letters а-я (ё not among them), by default one on the first line, as the feed gate has it."""
    line = "(?s)" if whole else ""
    other = "." if whole else r"[^\n]"
    return col(text).rlike(f"{line}^" + f"{other}*?[а-яА-Я]" * letters)


def clean_text(text: Column | str) -> Column:
    """Line breaks to spaces, quotes escaped, mentions cut out together with the white space before them."""
    flat = F.replace(F.replace(col(text), F.lit("\n"), F.lit(" ")), F.lit("'"), F.lit("\\'"))
    return F.regexp_replace(flat, r"(^@|\s@)[^\s]+", "")


def tokens(text: Column | str) -> Column:
    """Parts between white space, without empty ones."""
    return F.filter(F.split(col(text), r"\s+"), lambda x: x != "")


def surface(noun: Column | str, prep: Column | str) -> Column:
    return F.concat_ws(" ", col(prep), col(noun))


def unquote(text: Column | str) -> Column:
    return F.regexp_replace(col(text), "[\"'«»]", "")


# ---- ordered word lists


def windowed_pairs(words: Column | str, bag: int = SETTINGS.bag_size, full: bool = False) -> Column:
    """Pairs (w[i], w[i+n-1]) of window lengths 2 to ``bag``.

    The last two windows of each length are left out, as the counters expect; ``full`` keeps them.  Null
    arrays and those too short give an empty array.
    """
    w = col(words)
    cut = 0 if full else 2
    steps = F.sequence(F.lit(2), F.lit(bag))
    of = lambda n: F.when(F.size(w) - n - cut + 1 > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - n - cut, F.lit(0))), lambda i: F.struct(F.get(w, i).alias("w1"), F.get(w, i + n - 1).alias("w2"))))
    return F.flatten(F.filter(F.transform(steps, of), lambda x: x.isNotNull()))


def zipped(words: Column | str, sources: Column | str) -> Column:
    """Structs word, source; their ``windowed_pairs`` with a bag of 2 are the bigrams."""
    return F.arrays_zip(col(words).alias("word"), col(sources).alias("source"))


# ---- weights


def tf_idf(cnt: Column | str, df: Column | str, n: float = SETTINGS.corpus_size) -> Column:
    """(1 + ln cnt) * ln(n / df); 0 where df is above n, null where cnt or df is 0."""
    return (1 + F.log(col(cnt))) * F.when(col(df) <= n, F.log(F.try_divide(F.lit(n), col(df)))).otherwise(0.0)


def word_score(cnt: Column | str, n: float = SETTINGS.corpus_size) -> Column:
    """tf-idf of a word by its own count; negative for counts above n."""
    return (1 + F.log(col(cnt))) * F.log(F.try_divide(F.lit(n), col(cnt)))


def pair_distance(pair_cnt: Column | str, word_cnt: Column | str) -> Column:
    """-ln(pair_cnt / word_cnt); NaN for a word never counted, infinite for a pair never counted."""
    p, w = col(pair_cnt).cast("double"), col(word_cnt).cast("double")
    return F.when(w == 0, F.lit(float("nan"))).when(p == 0, F.lit(float("inf"))).otherwise(-F.log(p / w))


def similarity10(distance: Column | str) -> Column:
    return 10 * (1 - col(distance))


def trend_class(trend: Column | str, date: Column | str) -> Column:
    """Strong, mild or flat by the size of a trend; snapshots before 20160109111303 had a larger scale."""
    old = col(date) < "20160109111303"
    size = F.abs(col(trend))
    strong, mild = F.when(old, 15.0).otherwise(0.5), F.when(old, 3.0).otherwise(0.1)
    return F.when(size >= strong, "strong").when(size >= mild, "mild").otherwise("flat")


def trend_text(trend: Column | str) -> Column:
    """Two decimals, with a sign for growth."""
    return F.concat(F.when(col(trend) > 0, "+").otherwise(""), F.format_string("%.2f", col(trend).cast("double")))


def query_string(params: dict[str, Column]) -> Column:
    return F.concat_ws("&", *(F.concat(F.lit(k + "="), F.url_encode(v.cast("string"))) for k, v in params.items()))


def with_links(text: Column | str) -> Column:
    """Addresses wrapped as links."""
    return F.regexp_replace(col(text), r"(https?://[^\s<]+)", "<a href=\"$1\">$1</a>")


def hour_label(hour_digits: Column | str) -> Column:
    """``dd.MM HH:00`` of a yyyyMMddHH number."""
    s = col(hour_digits).cast("string")
    return F.concat(F.substring(s, 7, 2), F.lit("."), F.substring(s, 5, 2), F.lit(" "), F.substring(s, 9, 2), F.lit(":00"))


def members_key(ids: Column | str) -> Column:
    """Hex MD5 of the ids joined by commas."""
    return F.md5(F.array_join(F.transform(col(ids), lambda x: x.cast("string")), ","))


def title(texts: Column | str) -> Column:
    return F.array_join(F.array_distinct(col(texts)), " ")
