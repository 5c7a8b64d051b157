"""URL filters: host and path rules, then association rules over URL tokens.

Spark's FP-growth mines frequent token combinations from labelled URLs; rules whose consequent is the block label are
pruned by support (a share, and an absolute number of URLs) and confidence, and one that a shorter rule implies is
dropped. Tokens that are too rare, or suffice alone, are taken out first; if some URL then still has more than WIDE, whose
combinations may be too many, a search that passes over what can't be a shortest rule finds the same. Matching goes through an inverted index: a rule stands under the token that the fewest rules hold, and a URL
looks up its own tokens only. Rules are mined from all tokens of at most `sample` labelled rows, the smallest by a hash of
the key, which bounds what is gathered. Matching looks at all tokens of all URLs.

Null URLs and URLs without `://` have an empty host and path, match no rule and are allowed unless a mined rule blocks;
very long ones are matched whole. Repeated rows are judged alike, a repeated label counts blocked if one of its rows is;
of rules with equal confidence it doesn't matter which matches. Null keys have no label. Extra columns are ignored; an
empty table gives an empty result; without labels no rule is mined.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import combinations

import pyarrow as pa

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weightloom.llm.common import ship

#: Host and path prefix of each rule, and its verdict.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
BLOCK = "label=block"
#: Tokens of a URL up to which FP-growth looks at all their combinations.
WIDE = 12
#: Words whose pages are labelled as blocked.
TERMS = ("casino", "poker", "jackpot", "bets", "betting", "pills", "viagra", "cialis", "pharmacy", "adult", "xxx", "porn", "escort", "spam", "ads", "payday", "replica", "warez")
_A, _Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _A, _Z)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(host: Column, path: Column, rule: str) -> Column:
    name, _, rest = rule.partition("/")
    return ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, else null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        found = F.when(fits(host, path, rule), F.lit(rule)).otherwise(found)
    return found


def tokens(host: Column, path: Column) -> Column:
    """Distinct tokens: host labels with their place from the right, and words of the path."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    placed = F.transform(F.reverse(labels), lambda x, i: F.concat(F.lit("h"), i.cast("string"), F.lit(":"), x))
    words = F.regexp_extract_all(F.lower(path), F.lit(r"[^/._-]+"), F.lit(0))
    return F.array_distinct(F.concat(placed, F.transform(words, lambda x: F.concat(F.lit("p:"), x))))


def mine(labelled: DataFrame, support: float = 0.001, confidence: float = 0.8, sample: int = 100_000, least: int = 5) -> list[tuple[frozenset[str], float]]:
    """Rules (tokens, confidence) that imply block, none of which holds another one's tokens. labelled: (key, tokens, blocked)."""
    rows = labelled.filter("blocked is not null and size(tokens) > 0").orderBy(F.xxhash64("key"), "key", "tokens", "blocked").limit(sample)
    rows = rows.select("tokens", "blocked").withColumn("row", F.monotonically_increasing_id()).persist()
    baskets = None
    try:
        n = rows.count()
        if not n:
            return []
        count = math.ceil(min(1.0, max(support, least / n)) * n)
        each = rows.select("row", "blocked", F.explode("tokens").alias("token"))
        often = each.groupBy("token").agg(F.avg(F.col("blocked").cast("int")).alias("sure"), F.count_if("blocked").alias("hits")).filter(F.col("hits") >= count).persist()
        alone = [(frozenset([r.token]), r.sure) for r in often.filter(F.col("sure") >= confidence).collect()]
        # Rare tokens are in no rule, and those that suffice alone in no other one.
        left = each.join(often.filter(F.col("sure") < confidence).select("token"), "token")
        baskets = left.groupBy("row", "blocked").agg(F.collect_list("token").alias("items")).persist()
        widest, held = baskets.agg(F.max(F.size("items")), F.count("*")).first()
        if not held:
            rules = []
        elif widest > WIDE:
            rules = shortest([(r.items, r.blocked) for r in baskets.select("items", "blocked").collect()], count, confidence)
        else:
            mark = F.when(F.col("blocked"), F.array(F.lit(BLOCK))).otherwise(F.array().cast("array<string>"))
            marked = baskets.select(F.concat("items", mark).alias("items"))
            found = FPGrowth(itemsCol="items", minSupport=min(1.0, (count - 0.5) / held), minConfidence=confidence).fit(marked).associationRules
            found = found.filter(F.col("consequent") == F.array(F.lit(BLOCK))).select("antecedent", "confidence").collect()
            kept: dict[frozenset[str], float] = {}
            for r in sorted(found, key=lambda r: len(r.antecedent)):
                parts = frozenset(r.antecedent)
                if not any(frozenset(c) in kept for k in range(1, len(parts)) for c in combinations(parts, k)):
                    kept[parts] = r.confidence
            rules = list(kept.items())
    finally:
        rows.unpersist()
        if baskets is not None:
            often.unpersist()
            baskets.unpersist()
    return sorted([*alone, *rules], key=lambda x: sorted(x[0]))


def shortest(baskets: list[tuple[list[str], bool]], count: int, confidence: float) -> list[tuple[frozenset[str], float]]:
    """FP-growth's rules that hold no shorter one, found level by level; for baskets whose subsets are too many.

    A set with the rows of one of its subsets has that one's confidence too, so neither it nor a larger one is such a rule.
    """
    places: dict[str, list[int]] = {}
    for i, (items, _) in enumerate(baskets):
        for t in items:
            places.setdefault(t, []).append(i)

    def bitset(held: Iterable[int]) -> int:
        bits = bytearray(len(baskets) // 8 + 1)
        for i in held:
            bits[i >> 3] |= 1 << (i & 7)
        return int.from_bytes(bits, "little")

    blocked = bitset(i for i, (_, hit) in enumerate(baskets) if hit)
    out: list[tuple[frozenset[str], float]] = []

    def level(found: Iterable[tuple[tuple[str, ...], int]]) -> dict[tuple[str, ...], int]:
        """Sets that may grow; rules go to `out`."""
        grow = {}
        for parts, own in found:
            hits = (own & blocked).bit_count()
            if hits < count:
                continue
            if hits / own.bit_count() >= confidence:
                out.append((frozenset(parts), hits / own.bit_count()))
            else:
                grow[parts] = own
        return grow

    def larger(sets: dict[tuple[str, ...], int]) -> Iterator[tuple[tuple[str, ...], int]]:
        by_start: dict[tuple[str, ...], list[str]] = {}
        for parts in sorted(sets):
            by_start.setdefault(parts[:-1], []).append(parts[-1])
        for start, ends in by_start.items():
            for a, b in combinations(ends, 2):
                parts = (*start, a, b)
                smaller = [sets.get(parts[:k] + parts[k + 1 :]) for k in range(len(parts))]
                if None not in smaller:
                    own = sets[(*start, a)] & sets[(*start, b)]
                    if own not in smaller:
                        yield parts, own

    sets = level(((t,), bitset(held)) for t, held in places.items())
    while sets:
        sets = level(larger(sets))
    return out


def html_labels(pages: DataFrame, terms: tuple[str, ...] = TERMS, key: str = "page_id", html: str = "html") -> DataFrame:
    """Rows (key, blocked): pages labelled by a check of their html, whether one of the terms stands in it. Null html has no label."""
    found = F.lower(F.col(html)).rlike(rf"(?<![a-z0-9])(?:{'|'.join(terms)})(?![a-z0-9])")
    return pages.filter(F.col(html).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(found).alias("blocked"))


def index(rules: list[tuple[frozenset[str], float]]) -> dict[str, list[tuple[frozenset[str], float]]]:
    """Each rule under the token that the fewest rules hold."""
    common = Counter(t for parts, _ in rules for t in parts)
    out: dict[str, list[tuple[frozenset[str], float]]] = {}
    for parts, sure in rules:
        out.setdefault(min(parts, key=lambda t: (common[t], t)), []).append((parts, sure))
    return out


def judge(df: DataFrame, labels: DataFrame | None = None, rules: dict[str, str] | None = None, support: float = 0.001, confidence: float = 0.8, sample: int = 100_000, least: int = 5, key: str = "page_id", url: str = "url") -> DataFrame:
    """Rows (key, host, path, rule, verdict, mined: the confidence of the best mined rule). labels: (key, blocked)."""
    ship(df.sparkSession)
    rules = RULES if rules is None else rules
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("tokens", tokens(F.col("host"), F.col("path")))
    found: dict[str, list[tuple[frozenset[str], float]]] = {}
    if labels is not None:
        marks = labels.select(F.col(key).alias("labelled"), "blocked").filter("blocked is not null")
        found = index(mine(rows.join(marks, F.col("key") == F.col("labelled")), support, confidence, sample, least))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best = []
            for words in b.column("tokens").to_pylist():
                held = set(words)
                best.append(max((c for t in words for parts, c in found.get(t, ()) if parts <= held), default=None))
            columns = [b.column(n) for n in ("key", "host", "path", "rule")] + [pa.array(best, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "host", "path", "rule", "mined"])

    out = rows.mapInArrow(run, f"key {kind}, host string, path string, rule string, mined double")
    given = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair]) if rules else F.create_map().cast("map<string,string>")
    method = F.when(F.col("mined").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return out.select(F.col("key").alias(key), "host", "path", "rule", F.coalesce(F.get(F.map_values(F.map_filter(given, lambda k, _: k == F.col("rule"))), F.lit(0)), method).alias("verdict"), "mined")
