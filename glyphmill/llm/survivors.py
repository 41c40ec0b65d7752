"""Best representative of each duplicate group (problem 5): field-by-field survivorship.

Every record offers its values slot by slot, and one aggregation takes for each slot of a symbol the maximum of the
composite (whole value, source priority, time, record, value). Which values are whole is found just before: a value
that another one begins with is followed by it in sorted order. Symbols with a single record are left behind before
their texts are looked at; the symbols with very many records are sorted in ranges, so that one of them is many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions.symbols import source_code, symbol_struct, utc_instant
from glyphmill.session import cut, shuffle_width

#: Texts that stand in for a value, in lower case without outer white space: a parameter of every function here.
STAND_INS = ("-", "(none)", "n/a", "tbd", "todo", "see manual", "no description.", "description follows")
#: Ends and arguments that show an elided value.
ELIDED = r"(?:…|\.\.\.|\[cut\])$|\((?:…|\.\.\.)\)"
_ELISION = r"[\s\p{Z}]*(?:…|\.\.\.|\[cut\])$"
#: Source priorities are looked up in a literal map up to this many codes, by a join beyond it.
MAP_CODES = 1_000
#: Symbols with at least this many records are sorted in ranges; the heaviest of them, at most this many.
HOT_ROWS, HOT_SYMBOLS = 50_000, 256

_TRIM = r"^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$"
_KEYS = ["sym_name", "sym_category"]
_TEXTS = ("syntax", "description")


def _ranked(records: DataFrame, trust: DataFrame) -> DataFrame:
    """Adds codes (the record's source codes) and best_rank (null where none is known)."""
    codes = F.array_distinct(F.filter(F.transform("sources", source_code), lambda c: c.isNotNull()))
    records = records.withColumn("codes", F.coalesce(codes, F.array().cast("array<string>")))
    ranks = trust.select(source_code(F.col("source_code")).alias("code"), "trust_rank").filter("code is not null and trust_rank is not null").groupBy("code").agg(F.min("trust_rank").alias("rank"))
    known = ranks.limit(MAP_CODES + 1).collect()  # a small table by nature; its size is checked
    if len(known) <= MAP_CODES:
        if not known:
            return records.withColumn("best_rank", F.lit(None).cast("int"))
        lookup = F.create_map(*[F.lit(x) for r in known for x in (r.code, r.rank)])
        return records.withColumn("best_rank", F.array_min(F.transform("codes", lambda c: lookup[c])).cast("int"))
    best = records.select("rec_id", F.explode("codes").alias("code")).join(ranks, "code").groupBy("rec_id").agg(F.min("rank").cast("int").alias("best_rank"))
    return records.join(best, "rec_id", "left")


def _keyed(records: DataFrame) -> DataFrame:
    """Records with a name, with their symbol and what the slots need."""
    symbol = symbol_struct(F.col("name"), F.col("category"))
    rows = records.select("rec_id", *_TEXTS, "sources", "scraped_at", symbol.alias("s")).filter("s.sym_name is not null")
    return rows.select(F.col("s.sym_name").alias("sym_name"), F.coalesce("s.sym_category", F.lit("")).alias("sym_category"), "rec_id", *_TEXTS, "sources", "scraped_at")


def symbols(records: DataFrame) -> DataFrame:
    """(sym_name, sym_category, first_rec_id, n): the symbols with two or more records."""
    return _keyed(records).groupBy(*_KEYS).agg(F.min("rec_id").alias("first_rec_id"), F.count("*").alias("n")).filter("n > 1")


def _offers(rows: DataFrame, trust: DataFrame, stand_ins: tuple[str, ...]) -> DataFrame:
    """(keys, first_rec_id, slot, stem, whole, ord): what each record offers, slot by slot.

    Blank and stand-in values make no offer; an elided one is not whole, and its stem lacks the mark. ord is greatest
    for the best offer: least trust rank, latest time, least record, with nulls last; for a source the least record.
    """
    rows = _ranked(rows, trust)
    least = (-F.col("rec_id")).alias("neg_id")
    order = F.struct((-F.col("best_rank")).alias("trust"), F.unix_micros(utc_instant(F.col("scraped_at"))).alias("at"), least)
    first_given = F.struct(F.lit(None).cast("int").alias("trust"), F.lit(None).cast("bigint").alias("at"), least)

    def value(field: str) -> Column:
        text = F.regexp_replace(F.col(field), _TRIM, "")
        elided = text.rlike(ELIDED)
        stem = F.when(elided, F.regexp_replace(text, _ELISION, "")).otherwise(text)
        return F.when((text != "") & ~F.lower(text).isin(*stand_ins), F.struct(F.lit(field).alias("slot"), stem.alias("stem"), (~elided).alias("whole"), order.alias("ord")))

    given = F.transform("codes", lambda c: F.struct(F.concat(F.lit("sources/"), c).alias("slot"), F.lit("").alias("stem"), F.lit(True).alias("whole"), first_given.alias("ord")))
    slots = F.filter(F.concat(F.array(*[value(f) for f in _TEXTS]), given), lambda o: o.isNotNull())
    return rows.select(*_KEYS, "first_rec_id", F.explode(slots).alias("o")).select(*_KEYS, "first_rec_id", "o.*")


def _distinct(offers: DataFrame) -> DataFrame:
    """The distinct offers of each slot, with the best record of each."""
    return offers.groupBy(*_KEYS, "slot", "stem", "whole").agg(F.max("ord").alias("ord"), F.min("first_rec_id").alias("first_rec_id"))


def _told(values: DataFrame, following: Column) -> DataFrame:
    """``whole`` is false too for a value that the stem after it begins with. Equal stems sort elided first, so the whole one sees what follows."""
    begun = F.coalesce(following.startswith(F.col("stem")) & (following != F.col("stem")), F.lit(False))
    return values.withColumn("whole", F.col("whole") & ~begun)


def whole_values(values: DataFrame) -> DataFrame:
    """Distinct offers with ``whole`` told, each symbol in one task: fit for symbols of bounded size.

    In sorted order the texts that begin with a text follow it, so only the next one needs a look.
    """
    return _told(values, F.lead("stem").over(Window.partitionBy(*_KEYS, "slot").orderBy("stem", "whole")))


def whole_values_ranged(values: DataFrame) -> DataFrame:
    """``whole_values`` for symbols of any size: the offers are sorted in ranges, whatever symbol they belong to.

    The last offer of a range looks at the first one of the next range that holds any, a row per range.
    """
    order = [*_KEYS, "slot", "stem", "whole"]
    ranges = cut(values.repartitionByRange(shuffle_width(values.sparkSession), *order)).withColumn("_range", F.spark_partition_id())
    firsts = ranges.groupBy("_range").agg(F.min(F.struct(*order)).alias("_first"))
    later = firsts.withColumn("_later", F.lead("_first").over(Window.orderBy("_range"))).select("_range", "_later")
    following = F.coalesce(F.lead(F.struct(*order)).over(Window.partitionBy("_range").orderBy(*order)), F.col("_later"))
    joined = ranges.join(F.broadcast(later), "_range").withColumn("_next", following)
    same = F.col("_next.sym_name").eqNullSafe(F.col("sym_name")) & F.col("_next.sym_category").eqNullSafe(F.col("sym_category")) & F.col("_next.slot").eqNullSafe(F.col("slot"))
    return _told(joined, F.when(same, F.col("_next.stem"))).drop("_range", "_later", "_next")


def best_offers(records: DataFrame, trust: DataFrame, stand_ins: tuple[str, ...] = STAND_INS, hot_rows: int = HOT_ROWS, hot_symbols: int = HOT_SYMBOLS) -> DataFrame:
    """(sym_name, sym_category, slot, first_rec_id, best): the maximum of (whole, ord, value) of each slot.

    The texts are moved once, to their symbol, without those of symbols with one record; all that follows happens in
    place. Only the ``hot_symbols`` heaviest symbols of ``hot_rows`` records and more, told by a broadcast of that bound,
    take the way by ranges, after their equal offers are combined before the shuffle.
    """
    several = cut(symbols(records))
    hot = F.broadcast(several.filter(F.col("n") >= hot_rows).orderBy(F.desc("n"), *_KEYS).limit(hot_symbols).select(*_KEYS, F.lit(True).alias("_hot"), "first_rec_id"))
    rows = _keyed(records)
    usual = several.join(hot.drop("first_rec_id"), _KEYS, "left").filter("_hot is null").select(*_KEYS, "first_rec_id")
    local = rows.join(usual.hint("merge"), _KEYS)
    spread = rows.join(hot.drop("_hot"), _KEYS)
    told = whole_values(_distinct(_offers(local, trust, stand_ins)))
    if several.filter(F.col("n") >= hot_rows).limit(1).count():
        told = told.unionByName(whole_values_ranged(_distinct(_offers(spread, trust, stand_ins))))
    return told.groupBy(*_KEYS, "slot").agg(F.min("first_rec_id").alias("first_rec_id"), F.max(F.struct("whole", "ord", "stem")).alias("best")).filter("best.whole")


def survivors(records: DataFrame, trust: DataFrame, stand_ins: tuple[str, ...] = STAND_INS) -> DataFrame:
    """(first_rec_id, slot, from_rec_id): which record gives each slot of each symbol with two or more records.

    syntax and description come from the whole values (not blank, a stand-in, elided, or a cut-off of another value of
    the symbol) by best trust rank (none or unknown last), latest scrape (absent last), smallest record; a slot
    without a whole value gives no row. ``sources/CODE`` names the smallest record that gives the code, unknown
    codes too. Records without a name belong to no symbol. An empty table gives an empty result. Calling it runs
    jobs: the trust table is read, and the symbols with several records are written to the checkpoint folder.
    """
    return best_offers(records, trust, stand_ins).select("first_rec_id", "slot", (-F.col("best.ord.neg_id")).alias("from_rec_id"))


def merged_records(records: DataFrame, trust: DataFrame, stand_ins: tuple[str, ...] = STAND_INS) -> DataFrame:
    """(first_rec_id, syntax, description, sources): the surviving record of each symbol with two or more records.

    Texts are without outer white space, null where no record has a whole value; sources are all codes in order.
    """
    best = best_offers(records, trust, stand_ins)
    text = lambda field: F.max(F.when(F.col("slot") == field, F.col("best.stem"))).alias(field)
    code = F.when(F.col("slot").startswith("sources/"), F.substr("slot", F.lit(len("sources/") + 1)))
    return best.groupBy(*_KEYS).agg(F.min("first_rec_id").alias("first_rec_id"), text("syntax"), text("description"), F.array_sort(F.collect_set(code)).alias("sources")).drop(*_KEYS)
