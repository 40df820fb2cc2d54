"""Search with a table of queries.

Candidates come from an equi-join on one short substring ("gram") per query part: every text that
matches the wildcard pattern contains the gram, and the full pattern is checked on the joined rows.
The gram is the rarest one of the pattern in the corpus. While the queries fit a checked bound they
are broadcast, and the function table is only scanned; beyond it, both sides are shuffled on the
gram and a salt, so that a gram found in most functions is spread over many tasks. Few query parts
are sought in every text instead, which takes no grams.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from declarium.functions.query import parse_queries
from declarium.functions.text import ASCII_LOWER, ascii_fold, byte_form, strip, wildcard_pattern
from declarium.operators.grams import COLUMNS, NAME, SIGNATURE, GramTable, grams, text_grams
from declarium.operators.search import (
    FUNCTION_COLUMNS,
    candidate_order,
    default_candidate_limit,
    hit_order,
    score,
)
from declarium.operators.top import top_per_group
from declarium.plans.shared import written

# Rows and bytes of text of a table derived from queries that may be broadcast.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024
# Query parts up to which each text is searched for every one's longest run, without grams.
FEW_PROBES = 256
# Grams that may be named in a filter on the stored ones.
PUSHED_GRAMS = 1_000
# First functions that may be broadcast.
FIRST_ROWS = 10_000
# Slices of a join key where both sides are shuffled.
SALT = 32
# Byte lengths per bucket in the length join.
BAND = 8
UNBOUNDED = 1 << 30
# Distances one task should take, and the most tasks to cut them into.
DISTANCES_PER_TASK = 20_000_000
MOST_TASKS = 50_000

# Letters of a gram in the search by distance, and the distances it looks within, one after another.
GRAM = 3
RADII = [3]
# One of so many groups of functions tells how far a query has to look at most; where there are many, one of so many
# of those tells it first, down to so many pairs.
SAMPLED = 8
LEAST_PAIRS = 1_000_000
# Pairs of texts up to which distances are taken of all that lengths allow; beyond, texts share a gram first.
DENSE = 100_000_000
# Texts that may share a part's grams for it to be sought by them: one of so many, and so many in any case.
SELECTIVE, FEW_SHARING = 16, 10_000


class Extent(NamedTuple):
    """How many distinct texts and parts of queries there are, and bytes of the parts."""

    texts: int
    parts: int
    bytes: int


@dataclass
class QuerySet:
    """Parsed queries: ``keyed`` maps ids to distinct queries, ``distinct`` holds each one once."""

    keyed: DataFrame
    distinct: DataFrame
    total: int
    count: int
    bytes: int

    def fits(self, copies: int = 1) -> bool:
        """True if a table with so many rows per distinct query may be broadcast."""
        return _fits(self.count * copies, self.bytes * copies)


def _fits(rows: int, size: int) -> bool:
    return rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def _query_set(queries: DataFrame, blank_is_empty: bool = False) -> QuerySet:
    parsed = parse_queries(queries).where(F.col("error").isNull())
    if blank_is_empty:
        parsed = parsed.where(strip(F.col("query_text")) != "")
    key = F.to_json(F.array("name", "signature_norm"), {"ignoreNullFields": "false"})
    keyed = written(parsed.select("query_id", key.alias("qkey"), "name", "signature_norm"))
    grouped = keyed.groupBy("qkey", F.col("name").alias("qname"), F.col("signature_norm").alias("qsig"))
    return _sized(keyed.select("query_id", "qkey"), written(grouped.agg(F.count("*").alias("ids"))))


def _sized(keyed: DataFrame, distinct: DataFrame) -> QuerySet:
    extent = distinct.agg(
        F.count("*").alias("count"),
        F.coalesce(F.sum("ids"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.octet_length("qkey")), F.lit(0)).alias("bytes"),
    ).first()
    return QuerySet(keyed, distinct.drop("ids"), extent["total"], extent["count"], extent["bytes"])


def _probes(distinct: DataFrame) -> DataFrame:
    """One row per query part: its pattern, the longest literal run, and the grams to choose from."""
    sides = distinct.select(
        "qkey",
        "qname",
        F.explode(
            F.array(
                F.struct(F.lit(NAME).alias("side"), F.col("qname").alias("needle")),
                F.struct(F.lit(SIGNATURE).alias("side"), F.col("qsig").alias("needle")),
            )
        ).alias("part"),
    ).select("qkey", "qname", "part.*")
    folded = sides.where(F.col("needle").isNotNull()).select(
        "qkey",
        "side",
        wildcard_pattern(F.col("needle")).alias("pattern"),
        F.col("needle").rlike("[%_]").alias("wild"),
        F.when(F.col("side") == SIGNATURE, wildcard_pattern(F.col("qname"))).alias("name_pattern"),
        F.regexp_extract_all(ascii_fold(F.col("needle")), F.lit("[^%_]+"), F.lit(0)).alias("runs"),
    )
    longest = F.aggregate(
        "runs", F.lit(""), lambda best, run: F.when(F.length(run) > F.length(best), run).otherwise(best)
    )
    three = F.array_distinct(F.flatten(F.transform("runs", lambda run: grams(run, 3))))
    return (
        folded.withColumn("run", longest)
        .withColumn("grams", F.when(F.length("run") >= 3, three).otherwise(F.array("run")))
        .drop("runs")
    )


def _function_grams(functions: DataFrame, sizes: dict[str, list[int]], keep: list[str]) -> DataFrame:
    """One row per function, side and gram."""
    # Folded beforehand: an expression inside a lambda would be evaluated once per gram.
    folded = functions.select(*keep, *(ascii_fold(F.col(COLUMNS[side])).alias(f"_{side}") for side in sorted(sizes)))
    tagged = [_tagged(side, text_grams(F.col(f"_{side}"), sizes[side])) for side in sorted(sizes)]
    return folded.select(*keep, F.explode(F.concat(*tagged)).alias("_g")).select(*keep, "_g.*")


def _tagged(side: str, grams: Column) -> Column:
    return F.transform(grams, lambda gram: F.struct(F.lit(side).alias("side"), gram.alias("gram")))


def _equi_join(big: DataFrame, small: DataFrame, keys: list[str], fits: bool, salt_of: list[str]) -> DataFrame:
    """Join on ``keys``: broadcast ``small`` if it ``fits``, else shuffle both with a salt."""
    if fits:
        return big.join(F.broadcast(small), keys)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*salt_of), F.lit(SALT)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return salted.join(copies.hint("shuffle_merge"), [*keys, "_salt"]).drop("_salt")


def _matches(functions: DataFrame | GramTable, queries: QuerySet) -> DataFrame | None:
    """Every (query, function) pair where a part of the query matches, each once; None if no query
    has a part."""
    probes = written(_probes(queries.distinct))
    if isinstance(functions, GramTable):
        return None if probes.isEmpty() else _stored_matches(functions, probes, queries)
    few = probes.count()
    if 0 < few <= FEW_PROBES and queries.fits(6):
        return _few_matches(functions, probes.drop("grams"))
    # At most two sides times four sizes.
    used = probes.select("side", F.explode("grams").alias("gram")).select("side", F.length("gram").alias("size"))
    sizes: dict[str, list[int]] = {}
    for row in used.distinct().orderBy("side", "size").collect():
        sizes.setdefault(row["side"], []).append(row["size"])
    if not sizes:
        return None
    choices = probes.select("qkey", "side", F.explode("grams").alias("gram"))
    if any(3 in listed for listed in sizes.values()):
        frequent = _function_grams(functions, {s: [3] for s, listed in sizes.items() if 3 in listed}, [])
        counts = frequent.groupBy("side", "gram").agg(F.count("*").alias("n"))
        choices = choices.join(counts, ["side", "gram"], "left")
    else:
        choices = choices.withColumn("n", F.lit(0))
    chosen = _with_rarest(probes, choices)
    rows = _function_grams(functions.select(*FUNCTION_COLUMNS), sizes, FUNCTION_COLUMNS)
    # Two probes per query, each with up to three forms of its text.
    joined = _equi_join(rows, chosen, ["side", "gram"], queries.fits(6), ["path", "line", "column"])
    text = ascii_fold(F.when(F.col("side") == NAME, F.col("name")).otherwise(F.col("signature_norm")))
    return joined.where(_holds(text)).where(~_again()).select("qkey", *FUNCTION_COLUMNS)


def _few_matches(functions: DataFrame, probes: DataFrame) -> DataFrame:
    """The pairs of few query parts: reading a text once for each is less than cutting it into grams."""
    # Folded beforehand, not once per query part.
    sides = F.array(*(F.struct(F.lit(side).alias("side"), ascii_fold(F.col(column)).alias("text")) for side, column in COLUMNS.items()))
    texts = functions.select(*FUNCTION_COLUMNS, F.explode(sides).alias("_t")).select(*FUNCTION_COLUMNS, "_t.*")
    joined = texts.join(F.broadcast(probes), "side").where(_holds(F.col("text")))
    return joined.where(~_again()).select("qkey", *FUNCTION_COLUMNS)


def _holds(text: Column) -> Column:
    """Whether a text matches the pattern of the probe beside it."""
    return F.contains(text, F.col("run")) & (~F.col("wild") | F.like(text, F.col("pattern")))


def _again() -> Column:
    """The name side already yields a function whose name matches."""
    return F.coalesce(F.like(ascii_fold(F.col("name")), F.col("name_pattern")), F.lit(False))


def _with_rarest(probes: DataFrame, choices: DataFrame) -> DataFrame:
    """The probes, each with that of its grams that the fewest texts have."""
    rarest = choices.groupBy("qkey", "side").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("gram").alias("gram")))["gram"].alias("gram")
    )
    return probes.drop("grams").join(rarest, ["qkey", "side"])


def _stored_matches(table: GramTable, probes: DataFrame, queries: QuerySet) -> DataFrame:
    """The pairs by stored grams: gram to text, the pattern on each distinct text, text to functions."""
    choices = written(probes.select("qkey", "side", F.explode("grams").alias("gram")))
    asked = choices.select("side", "gram").distinct()
    size = asked.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("gram")), F.lit(0)).alias("bytes")).first()
    few = _fits(size["rows"], size["bytes"])
    counts = table.counts.join(_small(asked, few), ["side", "gram"], "left_semi")
    counts = counts.groupBy("side", "gram").agg(F.sum("n").alias("n"))
    chosen = written(_with_rarest(probes, choices.join(counts, ["side", "gram"], "left")))
    postings = table.postings
    if 2 * queries.count <= PUSHED_GRAMS:
        # Few enough to be looked up: the rows lie sorted by gram.
        postings = postings.where(F.col("gram").isin([row["gram"] for row in chosen.select("gram").distinct().collect()]))
    found = _equi_join(postings, chosen.select("qkey", "side", "gram"), ["side", "gram"], queries.fits(6), ["text_id"])
    found = found.select("qkey", "side", "text_id").join(table.texts, ["side", "text_id"])
    tests = _small(chosen.drop("gram"), queries.fits(6))
    # Several folders may hold a text.
    held = found.join(tests, ["qkey", "side"]).where(_holds(F.col("text"))).select("qkey", "side", "text_id", "text", "name_pattern")
    held = written(held.distinct())
    functions, parts = table.functions, []
    for side, column in COLUMNS.items():
        folded = ascii_fold(F.col(column))
        keyed = functions.withColumn("text_id", F.xxhash64(folded))
        # Two texts may share an id.
        parts.append(keyed.join(held.where(F.col("side") == side), "text_id").where(folded == F.col("text")))
    return parts[0].unionByName(parts[1].where(~_again())).select("qkey", *FUNCTION_COLUMNS)


def _first_functions(functions: DataFrame, order: list[Column], n: int) -> DataFrame:
    """First ``n`` functions, numbered from 1."""
    numbered = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))
    # After the limit this is one partition of at most ``n`` rows.
    first = functions.select(*FUNCTION_COLUMNS).orderBy(*order).limit(n)
    first = written(first.select(numbered.alias("seq"), F.struct(*FUNCTION_COLUMNS).alias("first")))
    size = first.agg(F.coalesce(F.sum(F.octet_length(F.to_json("first"))), F.lit(0))).first()[0]
    return _small(first, n <= FIRST_ROWS and size <= BROADCAST_BYTES)


def _with_first(queries: DataFrame, first: DataFrame, n: int) -> DataFrame:
    """Every query with each of the first functions, by their number."""
    numbered = queries.withColumn("seq", F.explode(F.sequence(F.lit(1), F.lit(n))))
    return numbered.join(first, "seq")


def _rows(functions: DataFrame | GramTable) -> DataFrame:
    return functions.functions if isinstance(functions, GramTable) else functions


def _candidates(functions: DataFrame | GramTable, queries: QuerySet, limit: int) -> DataFrame:
    """Candidates per distinct query: first matches by name, or first functions if none matches."""
    matched = _matches(functions, queries)
    functions, order = _rows(functions), candidate_order()
    packed = F.struct(*FUNCTION_COLUMNS)
    asked = queries.distinct
    if matched is None:
        asked = asked.withColumn("match", F.lit(None).cast(functions.select(packed.alias("f")).schema["f"].dataType))
    else:
        cut = top_per_group(matched, ["qkey"], order, limit).select("qkey", packed.alias("match"))
        asked = asked.join(cut, "qkey", "left")
    first = _first_functions(functions, order, limit)
    steps = F.when(F.col("match").isNull(), F.sequence(F.lit(1), F.lit(limit))).otherwise(F.array(F.lit(0)))
    filled = asked.withColumn("seq", F.explode(steps)).join(first, "seq", "left")
    return (
        filled.select("qkey", "qname", "qsig", F.coalesce("match", "first").alias("_f"))
        .where(F.col("_f").isNotNull())
        .select("qkey", "qname", "qsig", "_f.*")
    )


def _scored(rows: DataFrame) -> DataFrame:
    return rows.withColumn(
        "score", score(F.col("name"), F.col("signature_norm"), F.col("qname"), F.col("qsig"))
    )


def _by_id(hits: DataFrame, queries: QuerySet, *found: str) -> DataFrame:
    """Give every query id the ``found`` columns and functions of its distinct query."""
    columns = ["query_id", *found, *FUNCTION_COLUMNS]
    keyed = queries.keyed
    if queries.total > 4 * queries.count:
        # Many ids share a query: spread the ids of one query over several tasks.
        keyed = keyed.withColumn("_salt", F.pmod(F.xxhash64("query_id"), F.lit(SALT)).cast("int"))
        hits = hits.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        return keyed.join(hits, ["qkey", "_salt"]).select(*columns)
    return keyed.join(hits, "qkey").select(*columns)


def candidates_batch(functions: DataFrame | GramTable, queries: DataFrame, limit: int = 500) -> DataFrame:
    """Candidates of every query, as the single search would rank them; a negative ``limit`` means
    all of them."""
    asked = _query_set(queries)
    limit = limit if limit >= 0 else _rows(functions).count()
    return _by_id(_candidates(functions, asked, limit), asked)


def search_batch(
    functions: DataFrame | GramTable,
    queries: DataFrame,
    top: int = 20,
    candidate_limit: int | None = None,
    blank_is_empty: bool = False,
) -> DataFrame:
    """Hits of every query in ``query_id, query_text``, as the single search finds them.

    A ``GramTable`` keeps the grams of the functions from one search to the next. Queries with null text have no hits; ``parse_queries`` tells which they are. A negative
    ``candidate_limit`` ranks all matches, and all functions where none matches.
    """
    top = max(0, top)
    limit = default_candidate_limit(top) if candidate_limit is None else candidate_limit
    asked = _query_set(queries, blank_is_empty)
    if limit < 0:
        hits = _unlimited(functions, asked, top)
    else:
        ranked = Window.partitionBy("qkey").orderBy(*hit_order())
        hits = (
            _scored(_candidates(functions, asked, limit))
            .withColumn("rank", F.row_number().over(ranked))
            .where(F.col("rank") <= top)
        )
    return _by_id(hits.select("qkey", "rank", "score", *FUNCTION_COLUMNS), asked, "rank", "score")


def _unlimited(functions: DataFrame | GramTable, asked: QuerySet, top: int) -> DataFrame:
    matched, functions = _matches(functions, asked), _rows(functions)
    columns = ["qkey", "rank", "score", *FUNCTION_COLUMNS]
    if matched is None:
        return _exact(functions, asked, top, None).select(*columns)
    # A top of 0 still has to tell the queries that match.
    near = _scored(matched.join(_small(asked.distinct, asked.fits(2)), "qkey"))
    near = written(top_per_group(near, ["qkey"], hit_order(), max(1, top), rank="rank").select(*columns))
    rest = written(asked.distinct.join(near.select("qkey").distinct(), "qkey", "left_anti").withColumn("ids", F.lit(1)))
    unmatched = _sized(rest, rest)
    near = near.where(F.col("rank") <= top)
    if unmatched.count == 0:
        return near
    return near.unionByName(_exact(functions, unmatched, top, None).select(*columns))


def _small(rows: DataFrame, fits: bool) -> DataFrame:
    return F.broadcast(rows) if fits else rows


def search_exact_batch(
    functions: DataFrame, queries: DataFrame, top: int = 20, max_distance: int | None = None
) -> DataFrame:
    """Nearest functions of every query, over all functions.

    Distances are taken once per distinct name and once per distinct signature, and only within a radius in
    which ``top`` functions are known to lie: one that an eighth of the functions show, an eighth of those before, and so
    on. Where there are very many texts, a small one goes first, within which texts must share a rare gram at nearly the
    same place.
    """
    asked = _query_set(queries)
    return _by_id(_exact(functions, asked, max(0, top), max_distance), asked, "rank", "score")


def _tasks(functions: DataFrame, distances: int) -> int:
    cores = functions.sparkSession.sparkContext.defaultParallelism
    return max(cores, min(MOST_TASKS, distances // DISTANCES_PER_TASK))


def _unpack(rows: DataFrame) -> DataFrame:
    return rows.select("qkey", "qname", "qsig", "first.*")


def _bag(column: str, name: str) -> list[Column]:
    """The letters of a text in two numbers: a bit for each, up to twice for a letter, six times for a digit and
    eleven times for all others together."""

    def bits(rest: str, most: int, at: int) -> Column:
        return F.expr(f"shiftleft(shiftleft(1L, least(length({column}) - length({rest}), {most})) - 1, {at})")

    letters = [bits(f"replace({column}, '{c}', '')", 2, 2 * k) for k, c in enumerate(ASCII_LOWER)]
    letters.append(bits(f"regexp_replace({column}, '[^a-z0-9]', '')", 11, 52))
    digits = [bits(f"replace({column}, '{k}', '')", 6, 6 * k) for k in range(10)]
    return [reduce(Column.bitwiseOR, part).alias(f"{name}{k}") for k, part in enumerate((letters, digits))]


def _bags_near(radius: Column) -> Column:
    """Whether two bags are within the radius: an edit takes one letter away at most, and adds one at most."""

    def lacks(a: str, b: str) -> Column:
        return reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}{k}").bitwiseAND(F.bitwise_not(f"{b}{k}"))) for k in range(2)])

    return (lacks("_t", "_p") <= radius) & (lacks("_p", "_t") <= radius)


def _near_by_length(texts: DataFrame, most: int, parts: DataFrame, extent: Extent, on: tuple[str, ...] = ()) -> DataFrame:
    """Pairs equal in ``on`` whose lengths and letters leave room for the radius, in as many tasks as the pairs ask for."""
    length, radius = F.length("part"), F.col("radius")
    low = F.floor(F.greatest(F.lit(0), length - radius) / BAND)
    high = F.floor(F.least(F.lit(most), length + radius) / BAND)
    bands = parts.where(low <= high).select("part", "radius", *on, *_bag("part", "_p"), F.explode(F.sequence(low, high).cast("array<bigint>")).alias("band"))
    tasks = _tasks(texts, extent.texts * extent.parts)
    placed = texts.repartition(tasks).select("text", *on, *_bag("text", "_t"), F.floor(F.length("text") / BAND).alias("band"))
    copies = most // BAND + 1
    pairs = _equi_join(placed, bands, ["band", *on], _fits(extent.parts * copies, extent.bytes * copies), ["text"])
    return pairs.where(_bags_near(radius)).select("text", "part", "radius", *on)


def _positional_grams(rows: DataFrame, column: str, place: str) -> DataFrame:
    """One row per gram of a text with stand-ins for two letters before and behind it, and its place."""
    padded = F.concat(F.lit("\x01" * (GRAM - 1)), F.col(column), F.lit("\x02" * (GRAM - 1)))
    return rows.select(column, F.posexplode(grams(padded, GRAM)).alias(place, "gram"))


def _rarest_grams(texts: DataFrame, parts: DataFrame, radius: int) -> DataFrame:
    """``part, gram, place, n``: of each part the grams of which one is left in every text within the radius, and how
    many times texts have them."""
    counts = _positional_grams(texts, "text", "at").groupBy("gram").agg(F.count("*").alias("n"))
    rarest = Window.partitionBy("part").orderBy("n", "gram", "place")
    # Grams no text has are the rarest of all and count without being looked for.
    present = _positional_grams(parts, "part", "place").join(counts, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return present.withColumn("_r", F.row_number().over(rarest)).where((F.col("_r") <= GRAM * radius + 1) & (F.col("n") > 0)).drop("_r")


def _selective(asked: DataFrame, sides: dict[str, tuple[DataFrame, int, int]], radius: int) -> DataFrame:
    """The queries of which each part shares its rarest grams with few of the texts. To look for the others by grams
    would take more than to compare them with all texts."""
    for side, part in ((NAME, "qn"), (SIGNATURE, "qs")):
        texts, count, _ = sides[side]
        parts = asked.where(F.col(part).isNotNull()).select(F.col(part).alias("part")).distinct()
        sharing = _rarest_grams(texts, parts, radius).groupBy("part").agg(F.sum("n").alias("n"))
        many = sharing.where(F.col("n") > max(FEW_SHARING, count // SELECTIVE)).select(F.col("part").alias(part))
        asked = asked.join(many, part, "left_anti")
    return asked


def _near_by_grams(texts: DataFrame, parts: DataFrame, extent: Extent, radius: int) -> DataFrame:
    """Pairs that share a gram at nearly the same place.

    An edit changes at most ``GRAM`` grams and moves others by one place. So of ``GRAM * radius + 1`` grams of a
    part one is left unchanged in every text within the radius, at most ``radius`` places away; the
    rarest are taken. Parts need as many grams.
    """
    held = _positional_grams(texts, "text", "at")
    chosen = written(_rarest_grams(texts, parts, radius).select("part", "gram", "place"))
    size = GRAM * radius + 1
    pairs = _equi_join(held, chosen, ["gram"], _fits(extent.parts * size, extent.bytes * size), ["text"])
    return pairs.where(F.abs(F.col("at") - F.col("place")) <= radius).select("text", "part").distinct()


def _near(texts: DataFrame, most: int, parts: DataFrame, extent: Extent, radius: int | None) -> DataFrame:
    """``part, text, distance`` of all distinct texts within the ``radius`` of each of the distinct parts; it is
    given besides if it is the same for all and small, and there are very many texts."""
    if radius is not None:
        enough = F.length("part") + GRAM - 1 >= GRAM * radius + 1
        pairs = _near_by_grams(texts, parts.where(enough), extent, radius).withColumn("radius", F.lit(radius))
        pairs = pairs.unionByName(_near_by_length(texts, most, parts.where(~enough), extent))
    else:
        pairs = _near_by_length(texts, most, parts, extent)
    return _measured(pairs)


def _measured(pairs: DataFrame, *keep: str) -> DataFrame:
    """The pairs within their radius, with their distance."""
    pairs = pairs.where(F.abs(F.length("text") - F.length("part")) <= F.col("radius"))
    distance = F.expr("CASE WHEN text = part THEN 0 ELSE levenshtein(text, part, radius) END")
    # As a filter on a column the distance would be taken once for each condition on it.
    return pairs.select("part", "text", *keep, F.explode(F.filter(F.array(distance), lambda d: d >= 0)).alias("distance"))


def _within(
    groups: DataFrame, sides: dict[str, tuple[DataFrame, int, int]], asked: DataFrame, fits: bool, radius: int | None = None
) -> DataFrame:
    """``qid, bn, bs, copies, score`` of every group of functions within the ``radius`` of a query: distances are
    taken once per distinct name and once per distinct signature."""

    def near(side: str, rows: DataFrame, part: str, column: str) -> DataFrame | None:
        texts, count, most = sides[side]
        parts = written(rows.groupBy(F.col(part).alias("part")).agg(F.max("radius").alias("radius")))
        size = parts.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("part")), F.lit(0)).alias("bytes")).first()
        if not size["n"]:
            return None
        found = _near(texts, most, parts, Extent(count, size["n"], size["bytes"]), radius)
        return found.select(F.col("part").alias(part), F.col("text").alias(column), F.col("distance").alias(f"d{column}"))

    out = ["qid", "bn", "bs", "copies", "score"]
    only_name, only_signature = asked.where(F.col("qs").isNull()), asked.where(F.col("qn").isNull())
    both, found = asked.where(F.col("qn").isNotNull() & F.col("qs").isNotNull()), []
    signatures = near(SIGNATURE, asked.where(F.col("qs").isNotNull()), "qs", "bs")
    if signatures is not None:
        # What the nearest signature takes is not left for the name.
        signatures = written(signatures)
        extent = signatures.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("qs") + F.octet_length("bs")), F.lit(0)).alias("bytes")).first()
        signatures = _small(signatures, _fits(extent["n"], extent["bytes"]))
        least = signatures.groupBy("qs").agg(F.min("dbs").alias("least"))
        both = both.join(_small(least, fits), "qs").where(F.col("least") <= F.col("radius"))
        by_signature = signatures.join(_small(only_signature, fits), "qs").join(groups, "bs").withColumn("score", F.col("dbs"))
        found.append(by_signature.where(F.col("score") <= F.col("radius")).select(*out))
    names = near(NAME, only_name, "qn", "bn")
    if names is not None:
        by_name = names.join(_small(only_name, fits), "qn").where(F.col("dbn") <= F.col("radius")).join(groups, "bn")
        found.append(by_name.withColumn("score", F.col("dbn")).select(*out))
    if signatures is not None and radius is None:
        # A name is looked at only with signatures that leave room for it, and in the room they leave.
        left = both.drop("least").join(signatures, "qs").where(F.col("dbs") <= F.col("radius"))
        left = written(left.select("qid", "qn", "bs", "dbs", (F.col("radius") - F.col("dbs")).alias("radius")))
        size = left.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("qn") + F.octet_length("bs")), F.lit(0)).alias("bytes")).first()
        parts = written(left.groupBy(F.col("qn").alias("part"), "bs").agg(F.max("radius").alias("radius")))
        if size["n"]:
            # Names per signature, on the average.
            count = sides[NAME][1] // max(1, sides[SIGNATURE][1])
            texts = groups.select(F.col("bn").alias("text"), "bs")
            pairs = _measured(_near_by_length(texts, sides[NAME][2], parts, Extent(count, size["n"], size["bytes"]), ("bs",)), "bs")
            room = pairs.select(F.col("part").alias("qn"), F.col("text").alias("bn"), "bs", F.col("distance").alias("dbn"))
            room = room.join(_small(left, _fits(size["n"], size["bytes"])), ["qn", "bs"]).where(F.col("dbn") <= F.col("radius"))
            found.append(room.join(groups, ["bn", "bs"]).withColumn("score", F.col("dbn") + F.col("dbs")).select(*out))
        names = None
    else:
        left = both.withColumn("radius", F.col("radius") - F.col("least")) if signatures is not None else both.limit(0)
        names = near(NAME, left, "qn", "bn")
    if names is not None:
        room = names.join(_small(left, fits), "qn").where(F.col("dbn") <= F.col("radius"))
        scored = room.join(groups, "bn").join(signatures, ["qs", "bs"]).where(F.col("dbn") + F.col("dbs") <= F.col("radius") + F.col("least"))
        found.append(scored.withColumn("score", F.col("dbn") + F.col("dbs")).select(*out))
    if not found:
        return groups.limit(0).select(F.lit(0).cast("bigint").alias("qid"), "bn", "bs", "copies", F.lit(0).alias("score"))
    return reduce(lambda a, b: a.unionByName(b), found)


def _reach(rows: DataFrame, wanted: int) -> DataFrame:
    """``qid, reach``: the distance within which a query has ``wanted`` functions, for those that have as many."""
    counted = rows.groupBy("qid", "score").agg(F.sum("copies").alias("n"))
    so_far = F.sum("n").over(Window.partitionBy("qid").orderBy("score"))
    return counted.withColumn("n", so_far).where(F.col("n") >= wanted).groupBy("qid").agg(F.min("score").alias("reach"))


def _exact(functions: DataFrame, asked: QuerySet, top: int, max_distance: int | None) -> DataFrame:
    order, wanted = hit_order()[1:], max(1, top)
    # Copies of one name and signature have one distance: keep the first ``top`` of each.
    forms = functions.select(
        *FUNCTION_COLUMNS, byte_form(F.col("name")).alias("bn"), byte_form(F.col("signature_norm")).alias("bs")
    )
    heads = written(top_per_group(forms, ["bn", "bs"], order, wanted, rank="copy"))
    first = F.min_by(F.struct("name", "path", "line", "column", "signature_norm"), "copy")
    groups = written(heads.groupBy("bn", "bs").agg(F.max("copy").alias("copies"), first.alias("f")).select("bn", "bs", "copies", "f.*"))
    extent = groups.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("bn") + F.octet_length("bs")), F.lit(0)).alias("bytes")).first()
    narrow = _small(groups.select("bn", "bs", "copies"), _fits(extent["n"], extent["bytes"]))
    sides = {}
    for side, column in ((NAME, "bn"), (SIGNATURE, "bs")):
        texts = written(groups.select(F.col(column).alias("text")).distinct())
        size = texts.agg(F.count("*").alias("n"), F.coalesce(F.max(F.length("text")), F.lit(0)).alias("most")).first()
        sides[side] = (texts, size["n"], size["most"])
    blank = F.col("qname").isNull() & F.col("qsig").isNull()
    # Numbered, as rows of many pairs carry the number.
    numbered = asked.distinct.where(~blank).select(
        F.monotonically_increasing_id().alias("qid"), "qkey", byte_form(F.col("qname")).alias("qn"), byte_form(F.col("qsig")).alias("qs"))
    keys = written(numbered)
    open_, best, near = keys.drop("qkey"), [], []
    if max_distance is not None:
        near.append(_within(narrow, sides, open_.withColumn("radius", F.lit(max_distance)), asked.fits()))
    else:
        if max(sides[NAME][1], sides[SIGNATURE][1]) * asked.count > DENSE:
            # Most have near functions among very many: who has enough of them looks no further.
            for radius in RADII:
                tried = written(_selective(open_, sides, radius))
                if tried.isEmpty():
                    continue
                rows = _within(narrow, sides, tried.withColumn("radius", F.lit(radius)), asked.fits(), radius)
                reach = written(_reach(rows, wanted))
                near.append(rows.join(_small(reach, asked.fits()), "qid").where(F.col("score") <= F.col("reach")).drop("reach"))
                open_ = written(open_.join(_small(reach, asked.fits()), "qid", "left_anti"))
        pairs, shares = max(sides[NAME][1], sides[SIGNATURE][1]) * asked.count, [SAMPLED]
        while pairs // (shares[0] * SAMPLED) >= LEAST_PAIRS:
            shares.insert(0, shares[0] * SAMPLED)
        bounded = open_.withColumn("radius", F.lit(UNBOUNDED))
        for share in shares:
            some = groups.select("bn", "bs", "copies").where(F.pmod(F.xxhash64("bn", "bs"), F.lit(share)) == 0)
            few = {side: (some.select(F.col(column).alias("text")).distinct(), sides[side][1] // share, sides[side][2]) for side, column in ((NAME, "bn"), (SIGNATURE, "bs"))}
            some = _small(some, _fits(extent["n"], extent["bytes"]))
            reach = written(_reach(_within(some, few, bounded, asked.fits()), wanted))
            bounded = bounded.join(_small(reach, asked.fits()), "qid", "left").withColumn("radius", F.least("radius", "reach"))
            bounded = written(bounded.drop("reach"))
        near.append(_within(narrow, sides, bounded, asked.fits()))
    for rows in near:
        # The first ``top`` functions lie in the first ``top`` groups by their first function.
        first_groups = top_per_group(rows.join(groups.drop("copies"), ["bn", "bs"]), ["qid"], hit_order(), wanted)
        best.append(first_groups.select("qid", "score", "bn", "bs").join(keys.select("qid", "qkey"), "qid").drop("qid"))
    # Rows that hold a function's own text, whose size no query tells: left to the size Spark measures.
    hits = [heads.join(b, ["bn", "bs"]).select("qkey", "score", *FUNCTION_COLUMNS) for b in best]
    if top:
        first_rows = _unpack(_with_first(asked.distinct.where(blank), _first_functions(functions, order, top), top))
        hits.append(first_rows.select("qkey", F.lit(0).alias("score"), *FUNCTION_COLUMNS))
    if not hits:
        hits = [functions.limit(0).select(F.lit("").alias("qkey"), F.lit(0).alias("score"), *FUNCTION_COLUMNS)]
    ranked = Window.partitionBy("qkey").orderBy(*hit_order())
    every = reduce(lambda a, b: a.unionByName(b), hits)
    return every.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
