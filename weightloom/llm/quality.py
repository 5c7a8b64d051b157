"""Quality rules: word and line statistics of a text, and lines that recur across the documents of a host.

Lines are normalised (white space, case) and hashed; for each host the distinct texts that hold a line are counted, so
exact copies count once. Lines in over `min_docs` texts of a host, however many it has, are removed; a document that
loses too much of itself is rejected. A `share` of the host's texts can be demanded besides. Of the texts that would
be rejected for this alone, the one with the smallest key that holds a line keeps it, so one of near copies stays.

Only DataFrame functions are used. Texts are read once for all statistics, which are written as narrow rows; what
follows works on these. A line counts once per text before anything is shuffled, and partial sums keep a frequent line
from filling a task. Frequent lines, and the texts that lose some or go, are broadcast only if their measured number
is below a bound, else joined by (host, hash), where a hot key is one row on its side, so the other can be split.
Texts, lines and windows are compared by 64-bit hashes without a look at what was hashed.

Null texts have no words and fail; a very long text is worked through whole; an empty table gives an empty result; null
hosts are a host of their own; repeated rows are judged alike; of texts with equal keys that could keep a line, the
smallest hash does. Extra columns, whatever their names, pass through `clean` and are dropped by `judge`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weightloom.llm.common import work_dir

WORD, GAP = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Lines, frequent or lost by texts, up to which they are broadcast: at most about 100 MB with their hosts.
BROADCAST_LINES = 1_000_000


def let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def repeated_words(found: Column, width: int) -> Column:
    """Words that lie in a window of `width` words found twice or more in the array."""

    def hashes(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(w) - width + 1), lambda i: F.xxhash64(F.slice(w, i, width)))
        return F.when(F.size(w) > width, windows).otherwise(F.array().cast("array<bigint>"))

    def places(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            def same(e, k):
                before, after = F.get(s, k - 1)["h"], F.get(s, k + 1)["h"]
                return F.coalesce(before == e["h"], F.lit(False)) | F.coalesce(after == e["h"], F.lit(False))

            return F.sort_array(F.transform(F.filter(s, same), lambda e: e["i"]))

        return let(ordered, twice)

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(p, k + 1) - x, F.lit(width))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def count(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(places(h), covered))

    return let(hashes(found), count)


def statistics(text: Column, width: int = 8) -> dict[str, Column]:
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    return {
        "n_words": F.regexp_count(t, F.lit(WORD)).cast("long"),
        "word_chars": F.length(F.regexp_replace(t, GAP, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": let(words(t), lambda w: repeated_words(w, width)),
    }


def line_key(line: Column) -> Column:
    """Hash of a normalised line; null for a line without words."""
    return F.when(line.rlike(WORD), F.xxhash64(F.lower(F.btrim(F.regexp_replace(line, GAP, " ")))))


def measured(df: DataFrame, text: str, host: str, key: str) -> DataFrame:
    """Rows (id, host, t, statistics, base_failed, lines: [(k, n)]): what is needed of each row, with each line's hash and words."""
    t = F.coalesce(F.col(text), F.lit(""))
    found = F.transform(F.split(t, "\n"), lambda x: F.struct(line_key(x).alias("k"), F.regexp_count(x, F.lit(WORD)).alias("n")))
    stats = statistics(F.col(text))
    own = F.col(key) if key in df.columns else F.lit(0)
    return df.select(own.alias("id"), F.col(host).alias("host"), F.xxhash64(t).alias("t"), *[c.alias(n) for n, c in stats.items()], F.filter(found, lambda x: x["k"].isNotNull()).alias("lines"))


def texts_of(rows: DataFrame) -> DataFrame:
    """Each host's distinct texts by hash, with the smallest id."""
    return rows.groupBy("host", "t").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("n_words", "n_repeat_words", "lines")])


def frequent_lines(texts: DataFrame, min_docs: int = 5, share: float = 0.0) -> DataFrame:
    """Rows (host, line): the hashes of each host's lines above the limits, of the rows of texts_of."""
    counts = texts.select("host", F.explode(F.array_distinct("lines.k")).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") > min_docs)
    if share:
        totals = texts.groupBy("host").agg(F.count("*").alias("total")).alias("h")
        counts = counts.alias("c").join(totals, F.expr("c.host <=> h.host")).filter(F.col("n") > F.lit(share) * F.col("total")).select("c.host", "line")
    return counts.select("host", "line")


def same(x: str, y: str, *names: str) -> Column:
    """Whether two aliased sides agree in the host, null or not, and in the names."""
    return F.expr(" and ".join([f"{x}.host <=> {y}.host", *(f"{x}.{n} = {y}.{n}" for n in names)]))


def side(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= BROADCAST_LINES else df


class Judged:
    """The narrow rows, each host's texts, and the lines that texts lose, as tables in the work folder."""

    def __init__(self, df: DataFrame, min_docs: int, share: float, max_lost: float, text: str, host: str, key: str):
        self.spark, self.path, self.max_lost = df.sparkSession, work_dir(df.sparkSession, "lines"), max_lost
        self.rows = self.stored(measured(df, text, host, key), "rows")
        self.texts = self.stored(texts_of(self.rows), "texts")
        lines = self.stored(frequent_lines(self.texts, min_docs, share), "frequent")
        spread = self.texts.select("host", "t", F.explode("lines").alias("x")).select("host", "t", F.col("x.k").alias("line"), F.col("x.n").alias("n")).alias("s")
        hit = spread.join(side(lines, lines.count()).alias("f"), same("s", "f", "line")).groupBy("s.host", "s.t", "s.line").agg(F.sum("n").alias("n"))
        hit = self.stored(hit, "hit")
        losses = hit.groupBy("host", "t").agg(F.sum("n").alias("lost"))
        # A line of a text that would go for its lost words stays in the one with the smallest key, so one of near copies stays.
        poor = losses.alias("l").join(self.texts.alias("x"), same("l", "x", "t")).filter(~base_failed(lambda c: F.col(c)) & ~self.enough(F.col("n_words") - F.col("lost")))
        poor = self.stored(poor.select("l.host", "l.t", "x.id"), "poor")
        first = hit.alias("h").join(side(poor, poor.count()).alias("p"), same("h", "p", "t")).groupBy("h.host", "h.line").agg(F.min(F.struct("p.id", "h.t"))["t"].alias("t"))
        lost = hit.alias("h").join(first.alias("f"), same("h", "f", "t", "line"), "left_anti").groupBy("host", "t").agg(F.collect_set("line").alias("frequent"), F.sum("n").alias("lost"))
        self.lost = self.stored(lost, "lost")

    def stored(self, rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.path}/{name}")

    def enough(self, left: Column) -> Column:
        return left >= (1 - self.max_lost) * F.col("n_words")

    def verdicts(self, rows: DataFrame) -> DataFrame:
        """The rows (host, t, ...) with frequent (the lines they lose), n_words_left, base_failed and kept."""
        n = self.lost.agg(F.coalesce(F.sum(F.size("frequent")), F.lit(0))).first()[0]
        found = rows.alias("r").join(side(self.lost, n).alias("l"), same("r", "l", "t"), "left").select("r.*", "l.frequent", (F.col("r.n_words") - F.coalesce("l.lost", F.lit(0))).alias("n_words_left"))
        found = found.withColumn("base_failed", base_failed(lambda c: F.col(c)))
        return found.withColumn("kept", ~F.col("base_failed") & self.enough(F.col("n_words_left")))


def base_failed(column) -> Column:
    return (column("n_words") < 20) | (100 * column("n_repeat_words") > 30 * column("n_words"))


def kept_text(text: Column, frequent: Column) -> Column:
    """The text without its frequent lines."""

    def stays(line: Column) -> Column:
        return ~F.coalesce(F.array_contains(frequent, line_key(line)), F.lit(False))

    return F.when(frequent.isNull(), text).otherwise(F.array_join(F.filter(F.split(text, "\n"), stays), "\n"))


def judge(df: DataFrame, min_docs: int = 5, share: float = 0.0, max_lost: float = 0.75, text: str = "text", host: str = "source", key: str = "doc_id") -> DataFrame:
    """Rows (key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_words_left)."""
    j = Judged(df, min_docs, share, max_lost, text, host, key)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_words_left"]
    return j.verdicts(j.rows.drop("lines")).select(F.col("id").alias(key), *names)


def clean(df: DataFrame, min_docs: int = 5, share: float = 0.0, max_lost: float = 0.75, text: str = "text", host: str = "source", key: str = "doc_id") -> DataFrame:
    """The rows kept, in the table's own columns, without their frequent lines."""
    j = Judged(df, min_docs, share, max_lost, text, host, key)
    changed = j.stored(j.verdicts(j.texts.drop("lines")).filter("not kept or frequent is not null").select("host", "t", "kept", "frequent"), "changed")
    own = f"t_{uuid.uuid4().hex}"
    rows = df.withColumn(own, F.xxhash64(F.coalesce(F.col(text), F.lit("")))).alias("r")
    n = changed.agg(F.coalesce(F.sum(1 + F.coalesce(F.size("frequent"), F.lit(0))), F.lit(0))).first()[0]
    same_text = F.col(f"r.{host}").eqNullSafe(F.col("c.host")) & (F.col(f"r.{own}") == F.col("c.t"))
    rows = rows.join(side(changed, n).alias("c"), same_text, "left").filter(F.coalesce(F.col("c.kept"), F.lit(True)))
    return rows.select(*[kept_text(F.col(f"r.{c}"), F.col("c.frequent")).alias(c) if c == text else F.col(f"r.{c}") for c in df.columns])
