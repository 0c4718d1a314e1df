"""Listings, options, targets, shop tags, garment tags, codes and passes from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.operators.positions import number_rows
from pricetide.sources import dictionary

SOURCES = [("auction", "オークション", ""), ("market", "フリマ", "")]

NOISE_BY_ORDER = {
    0: " まとめ売り", 1: " 3枚セット", 2: " セットアップ", 3: " ジャンク",
    4: " キッズ", 5: " カタログ", 6: " タグのみ", 7: " レプリカ",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings without a position, with their order keys."""
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    suffix = F.lit("")
    for rest, text in NOISE_BY_ORDER.items():
        suffix = F.when(F.col("l_orderkey") % 37 == rest, F.lit(text)).otherwise(suffix)
    price = (
        F.when(F.col("l_orderkey") % 53 == 0, F.col("l_extendedprice") / 100)
        .when(F.col("l_orderkey") % 59 == 0, F.col("l_extendedprice") * 100)
        .when(F.col("l_orderkey") % 61 == 0, F.col("l_extendedprice") * 5)
        .otherwise(F.col("l_extendedprice"))
    )
    in_auction = (F.col("l_suppkey") % 11 == 3) | (F.col("l_linestatus") == "O")
    return line.join(part, F.col("p_partkey") == F.col("l_partkey")).select(
        F.col("l_suppkey").alias("quote_id"),
        F.when(in_auction, F.lit("auction")).otherwise(F.lit("market")).alias("source"),
        F.concat(
            "p_brand", F.lit(" "), "p_name", F.lit(" MD"),
            F.lpad(F.col("p_partkey").cast("string"), 5, "0"), suffix,
        ).alias("title"),
        F.floor(price).cast("bigint").alias("price"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
    )


def unnumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_listings(spark, sf_dir).select("quote_id", "source", "title", "price")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``quote_id, source, pos, title, price``."""
    return number_rows(
        raw_listings(spark, sf_dir),
        ["quote_id", "source"],
        ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"],
        F.floor(F.col("l_orderkey") / 65536),
    ).select("quote_id", "source", "pos", "title", "price")


def options(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        key.alias("quote_id"),
        F.when(key % 5 == 0, F.lit("キッズ widget")).when(key % 5 == 1, F.lit("まとめ売り"))
        .otherwise(F.lit("widget")).alias("query"),
        F.when(key % 4 == 1, F.lit(5000).cast("bigint")).alias("price_min"),
        F.when(key % 4 == 2, F.lit(90000).cast("bigint")).alias("price_max"),
        F.when(key % 3 == 0, F.lit("HOT, old")).otherwise(F.lit("")).alias("exclude_csv"),
        (key % 13 != 5).alias("use_default_excludes"),
        (key % 9 != 4).alias("remove_outliers"),
        F.lit(1.5).alias("iqr_k"),
    )


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``quote_id, brand, model_numbers``."""
    supplier, part = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part")
    key = F.col("s_suppkey")
    brand = F.when(key % 7 == 0, F.lit(None).cast("string")).when(
        key % 7 == 1, F.lit("NoSuchBrand")
    ).otherwise(F.col("p_brand"))
    brands = supplier.join(part, F.col("p_partkey") == key).select(key.alias("quote_id"), brand.alias("brand"))
    # every part is a model of one quote; about 20 parts per supplier at every scale
    suppliers = table(spark, sf_dir, "supplier").agg(F.count(F.lit(1))).scalar()
    models = (
        part.select(
            (F.col("p_partkey") % suppliers).alias("quote_id"),
            F.concat(F.lit("MD-"), F.lpad(F.col("p_partkey").cast("string"), 5, "0")).alias("model"),
        )
        .filter(F.col("quote_id") % 7 > 1)
        .groupBy("quote_id")
        .agg(F.array_sort(F.collect_list("model")).alias("model_numbers"))
    )
    return brands.join(models, "quote_id", "left")


def shop_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tag_id, quote_id, shop_price, condition``."""
    suppliers = table(spark, sf_dir, "supplier").agg(F.count(F.lit(1))).scalar()
    order = F.col("o_orderkey")
    words = {"1-URGENT": "new", "2-HIGH": "mint", "3-MEDIUM": "normal", "5-LOW": "worn"}
    condition = F.lit("unknown")
    for priority, word in words.items():
        condition = F.when(F.col("o_orderpriority") == priority, F.lit(word)).otherwise(condition)
    return table(spark, sf_dir, "orders").select(
        order.alias("tag_id"),
        (order % suppliers).alias("quote_id"),
        F.when(order % 101 == 0, F.lit(0)).otherwise(F.floor(F.col("o_totalprice") / 3))
        .cast("bigint").alias("shop_price"),
        condition.alias("condition"),
    )


def garment_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tag_id, text``."""
    key, size = F.col("p_partkey"), F.col("p_size")
    maker = F.lit("ステンカラーコート")
    for rest, text in {0: "THE NORTH FACE", 1: "patagonia", 2: "CARHARTT WIP", 3: "ユニクロ"}.items():
        maker = F.when(key % 5 == rest, F.lit(text)).otherwise(maker)
    letter = F.when(size % 3 == 0, F.lit("S")).when(size % 3 == 1, F.lit("M")).otherwise(F.lit("L"))
    sized = F.when(size % 2 == 0, F.concat(F.lit("SIZE: "), letter)).otherwise((size + 70).cast("string"))
    return table(spark, sf_dir, "part").select(
        key.alias("tag_id"),
        F.concat_ws(
            "\n", maker, F.concat(F.lit("ND"), F.lpad(key.cast("string"), 5, "0")), sized, F.col("p_name"),
            F.lit("表地 ナイロン100%"), F.lit("MADE IN JAPAN"),
        ).alias("text"),
    )


SELECTED = [1, 4, 1_000_000_000]


def spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``canonical, alias, folded, alias_ord``: the fixed dictionary and the number of every seventh part as its maker's."""
    fixed = dictionary.brand_aliases(spark)
    number = F.concat(F.lit("nd"), F.lpad(F.col("p_partkey").cast("string"), 5, "0"))
    grown = table(spark, sf_dir, "part").where(F.col("p_partkey") % 7 == 3).select(
        F.col("p_brand").alias("canonical"), number.alias("alias"), F.upper(number).alias("folded"),
        (F.col("p_partkey") + 1000).cast("int").alias("alias_ord"))
    return fixed.unionByName(grown)


ORIGINS = ["日本製", "中国製", "ベトナム製", "イタリア製", "アメリカ製", "米国製"]


def plain_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tag_id, text``: a line of digits, a size or not, an origin in Japanese on all but every seventh tag."""
    key = F.col("p_partkey")
    origin = F.get(F.array(*[F.lit(o) for o in ORIGINS]), (key % 6).cast("int"))
    return table(spark, sf_dir, "part").select(
        key.alias("tag_id"),
        F.concat_ws(
            "\n", F.lit("コート"), (F.lit(10000) + key).cast("string"),
            F.when(key % 2 == 0, F.lit("160")), F.when(key % 7 != 0, origin),
        ).alias("text"),
    )


def bare_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tag_id, payload``: without candidates, with blank text, or with the part's name."""
    key = F.col("p_partkey")
    text = F.when(key % 3 == 0, F.lit("  ")).otherwise(F.col("p_name"))
    answer = F.struct(F.struct(F.array(F.struct(text.alias("text"))).alias("parts")).alias("content"))
    return table(spark, sf_dir, "part").select(
        key.alias("tag_id"),
        F.when(key % 3 == 1, F.lit("{}")).otherwise(F.to_json(F.struct(F.array(answer).alias("candidates")))).alias("payload"))


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scan_id, code``."""
    order = F.col("o_orderkey")
    text = order.cast("string")
    return table(spark, sf_dir, "orders").select(
        order.alias("scan_id"),
        F.when(order % 4 == 0, (F.lit(4900000000000) + order).cast("string"))
        .when(order % 4 == 1, F.concat(F.lpad((F.col("o_custkey") % 100).cast("string"), 2, "0"), F.lpad(text, 11, "0")))
        .when(order % 4 == 2, F.concat(F.lit("96-"), F.lpad(text, 6, "0")))
        .otherwise(F.lpad(text, 12, "0")).alias("code"),
    )


def ocr_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``photo_id, ord, kind, degrees, confidence``."""
    event = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.floor(event / 11).cast("bigint").alias("photo_id"),
        (event % 11).alias("ord"),
        F.when(event % 11 < 8, F.lit("probe")).otherwise(F.lit("variant")).alias("kind"),
        ((event % 4) * 90).alias("degrees"),
        (F.floor("value").cast("bigint") % 100).alias("confidence"),
    )


PAGE = 20


def _rendered(form: str) -> list:
    """The lines a listing takes up on a page of the given form."""
    title, price = F.col("title"), F.col("price").cast("string")
    asked = F.floor(F.col("price") * 1.6).cast("bigint").cast("string")
    forms = {
        "auction": [title, F.concat(F.lit("即決 "), asked, F.lit("円")), F.concat(F.lit("落札 "), price, F.lit("円")),
                    F.lit("2026年8月20日")],
        "market": [F.concat(F.lit("¥"), price), title, F.lit("送料込み"), F.lit("SOLD")],
        "inline": [F.concat(title, F.lit(" "), price, F.lit("円 2026年9月1日"))],
        "csv": [F.concat(title, F.lit(","), price)],
        "tsv": [F.concat(title, F.lit("\t"), price, F.lit("円"))],
        "bare": [price],
    }
    return forms[form]


def pastes(spark: SparkSession, sf_dir: str, form: str) -> DataFrame:
    """``quote_id, source, page, text``: listings rendered as pages of 20."""
    page = F.floor(F.col("pos") / PAGE).alias("page")
    lines = F.concat_ws("\n", *_rendered(form)).alias("line")
    # a page holds 20 listings
    return (
        listings(spark, sf_dir)
        .select("quote_id", "source", page, "pos", lines)
        .groupBy("quote_id", "source", "page")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("rows"))
        .select("quote_id", "source", "page", F.array_join(F.col("rows.line"), "\n").alias("text"))
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tag_id, payload``: tag reading answers, some cut short, some blocked."""
    key = F.col("p_partkey")
    tag = F.to_json(F.struct(
        F.concat(F.lit(" "), F.col("p_brand"), F.lit("\n"), F.col("p_name"), F.lit(" ")).alias("text"),
        F.when(key % 3 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" "), F.col("p_brand"))).alias("brand"),
        F.array(F.concat(F.lit("MD"), F.lpad(key.cast("string"), 5, "0")), F.lit(" ")).alias("model_numbers"),
        F.array(F.concat(F.col("p_size").cast("string"), F.lit(" "))).alias("sizes"),
        F.array("p_type").alias("materials"),
        F.when(key % 2 == 0, F.lit("JAPAN")).otherwise(F.lit("")).alias("made_in"),
    ))
    answer = F.when(key % 10 == 0, F.concat(F.lit("{ "), F.col("p_name"))).otherwise(tag)
    cut = F.length("answer") - 3
    parts = F.array(
        F.struct(F.substr("answer", F.lit(1), cut).alias("text")), F.struct(F.substr("answer", cut + 1).alias("text"))
    )
    return table(spark, sf_dir, "part").select(key.alias("tag_id"), answer.alias("answer")).select(
        "tag_id",
        F.to_json(F.struct(
            F.when(F.col("tag_id") % 25 != 1, F.array(F.struct(F.struct(parts.alias("parts")).alias("content"))))
            .alias("candidates"),
            F.when(F.col("tag_id") % 25 == 1, F.struct(F.lit("SAFETY").alias("blockReason"))).alias("promptFeedback"),
        )).alias("payload"),
    )


def record_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``quote_id, query, created_at, tag_text, groups``: what is saved along with a quote."""
    suppliers = table(spark, sf_dir, "supplier").agg(F.count(F.lit(1))).scalar()
    dated = table(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % suppliers).alias("quote_id")).agg(
        F.max("o_orderdate").alias("day"))
    # a record holds its own pasted pages by definition
    groups = pastes(spark, sf_dir, "market").groupBy("quote_id").agg(
        F.collect_list(F.struct(F.col("source").alias("key"), F.col("source").alias("label"), "text")).alias("groups"))
    number = F.lpad(F.col("quote_id").cast("string"), 5, "0")
    return dated.join(groups, "quote_id").select(
        "quote_id",
        F.concat(F.lit("widget "), F.col("quote_id").cast("string")).alias("query"),
        F.timestamp_seconds(F.unix_timestamp("day") + F.col("quote_id")).alias("created_at"),
        F.when(F.col("quote_id") % 2 == 0, F.concat(F.lit("MD"), number)).otherwise(F.lit("")).alias("tag_text"),
        "groups",
    )


UNREADABLE_PAGE = "ログインしてください\n商品が見つかりません"


def mixed_pastes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``quote_id, source, page, text``: readable pages, one page without amounts, one empty page."""
    key, auction = F.col("quote_id"), F.col("source") == "auction"
    pages = pastes(spark, sf_dir, "market").where(
        (auction & (key % 4).isin(0, 3)) | (~auction & (key % 2 == 1)))
    blank = table(spark, sf_dir, "supplier").where(F.col("s_suppkey") % 4 < 3).where(F.col("s_suppkey") % 4 > 0).select(
        F.col("s_suppkey").alias("quote_id"), F.lit("auction").alias("source"), F.lit(0).cast("bigint").alias("page"),
        F.when(F.col("s_suppkey") % 4 == 1, F.lit(UNREADABLE_PAGE)).otherwise(F.lit("")).alias("text"))
    return pages.unionByName(blank)


def mixed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings of every other quote given directly, some without a price."""
    given = listings(spark, sf_dir).where((F.col("source") == "market") & (F.col("quote_id") % 2 == 0))
    unpriced = (F.col("quote_id") % 8 == 0) & (F.col("pos") == 0)
    return given.withColumn("price", F.when(~unpriced, F.col("price")))


def mixed_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options for two quotes in three, and for some quotes that have no listings."""
    given = options(spark, sf_dir)
    beyond = given.where(F.col("quote_id") % 5 == 0).withColumn("quote_id", F.col("quote_id") + 1_000_000)
    return given.where(F.col("quote_id") % 3 > 0).unionByName(beyond)


def photo_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ocr_passes`` with the lines each pass has read: those of one document, with a confidence each."""
    docs = table(spark, sf_dir, "documents")
    count = docs.agg(F.count(F.lit(1))).scalar()
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(
        x.alias("text"), ((F.length(x) * 7 + i * 13) % 100).cast("double").alias("confidence")))
    passes = ocr_passes(spark, sf_dir).withColumn("doc_id", (F.col("photo_id") * 11 + F.col("ord")) % count)
    return passes.join(docs.select("doc_id", lines.alias("lines")), "doc_id", "left").drop("doc_id")
