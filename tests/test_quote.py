import random
import statistics

import pytest
from pyspark.sql import functions as F

from pricetide.operators import histogram, stats, views
from pricetide.plans.quote import QuoteJob
from pricetide.plans.replay import quotes_from_pastes

SOURCES = [("yahoo", "ヤフオク", ""), ("mercari", "メルカリ", "")]


def rows_of(source, prices, title="ダウンジャケット L", quote="q"):
    return [(quote, source, i, title, p) for i, p in enumerate(prices)]


@pytest.fixture
def job(spark):
    def make(rows, query="ダウン", target=None, groups=None, **options):
        kinds = {"exclude_words": "array<string>", "price_min": "bigint", "price_max": "bigint",
                 "remove_outliers": "boolean", "iqr_k": "double"}
        listings = spark.createDataFrame(rows, "quote_id string, source string, pos bigint, title string, price bigint")
        schema = "quote_id string, query string" + "".join(f", {k} {kinds[k]}" for k in options)
        quotes = sorted({r[0] for r in rows} | {g[0] for g in groups or []})
        given = spark.createDataFrame([(q, query, *options.values()) for q in quotes], schema)
        targets = None
        if target:
            targets = spark.createDataFrame([(q, *target) for q in quotes],
                                            "quote_id string, brand string, model_numbers array<string>")
        if groups is not None:
            groups = spark.createDataFrame(groups, "quote_id string, source string, error string, untitled int")
        return QuoteJob(listings, given, targets, groups, SOURCES)

    return make


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_equal_weight_of_sources(job):
    q = one(job(rows_of("yahoo", [1000, 2000, 3000]) + rows_of("mercari", [5000, 6000, 7000])).quotes)
    assert (q.equal_weight_median, q.combined_count, q.sources_used) == (4000, 6, ["yahoo", "mercari"])


def test_larger_source_does_not_pull(job):
    q = one(job(rows_of("yahoo", [2000] * 50) + rows_of("mercari", [6000] * 4)).quotes)
    assert (q.equal_weight_median, q.weighted_mean) == (4000, 2296)


def test_one_source_is_enough_and_said(job):
    j = job(rows_of("yahoo", [5000, 6000, 7000, 8000, 9000]))
    assert one(j.quotes).equal_weight_median == 7000
    assert any("片方のサイトだけ" in w for w in one(j.warnings).warnings)


def test_empty_source_stays_visible(job):
    groups = [("q", "yahoo", None, 0), ("q", "mercari", None, 0)]
    j = job(rows_of("mercari", [5000, 6000, 7000]), groups=groups)
    by_source = {r.source: r for r in j.source_stats.collect()}
    assert by_source["yahoo"]["count"] == 0 and by_source["yahoo"].median is None and by_source["yahoo"].n_read == 0
    q = one(j.quotes)
    assert q.combined_count == 3 and q.sources_used == ["mercari"]


def test_nothing_pasted_is_said(job):
    j = job([("other", "yahoo", 0, "x", 5000)], groups=[("q", "yahoo", None, 0), ("other", "yahoo", None, 0)])
    got = {r.quote_id: r.warnings for r in j.warnings.collect()}
    assert len(got["q"]) == 1 and "貼り付けて" in got["q"][0]


def test_outliers_and_switch(job):
    prices = [5000, 5100, 5200, 5300, 5400, 5500, 5600, 5700, 900000]
    on = one(job(rows_of("yahoo", prices)).source_stats)
    off = one(job(rows_of("yahoo", prices), remove_outliers=False).source_stats)
    assert (on.outlier_count, on.max, on.excluded_count) == (1, 5700, 1)
    assert (off.outlier_count, off.max) == (0, 900000)


def test_exclude_words_and_lower_bound(job):
    rows = [("q", "yahoo", 0, "ダウン L", 5000), ("q", "yahoo", 1, "ジュニア ダウン", 3000)]
    assert one(job(rows, exclude_words=["ジュニア"]).source_stats)["count"] == 1
    assert one(job(rows_of("yahoo", [1000, 5000, 9000]), price_min=4000).source_stats)["count"] == 2


TARGET = ("ノースフェイス", ["ND91841"])
TIERED = [
    ("THE NORTH FACE ヌプシ ND91841 L", 18500), ("ノースフェイス ND-91841 ヌプシ M", 17200),
    ("ノースフェイス ND91841 S", 16000), ("ノースフェイス Tシャツ L", 2600),
    ("ノースフェイス マウンテンパーカー M", 8800), ("アディダス ジャージ上下", 4200),
]


def tiered(entries):
    return [("q", "yahoo", i, t, p) for i, (t, p) in enumerate(entries)]


def test_model_basis(job):
    j = job(tiered(TIERED), target=TARGET, remove_outliers=False)
    q = one(j.quotes)
    assert (q.basis_tier, q.combined_count, q.combined_median) == ("model", 3, 17200)
    assert (q.n_model, q.n_brand, q.n_loose, q.n_basis) == (3, 2, 1, 3)
    assert sorted(r.price for r in stats.kept_prices(j.settled).collect()) == [16000, 17200, 18500]


def test_no_target_uses_everything(job):
    q = one(job(tiered(TIERED), remove_outliers=False).quotes)
    assert (q.basis_tier, q.has_target, q.combined_count) == ("all", False, 6)


def test_widening_to_brand_and_to_all(job):
    j = job(tiered([TIERED[0], TIERED[3], TIERED[4], TIERED[5]]), target=TARGET, remove_outliers=False)
    q = one(j.quotes)
    assert (q.basis_tier, q.combined_count) == ("brand", 3)
    assert any("ブランド一致まで広げて" in w for w in one(j.warnings).warnings)
    j = job(tiered([("アディダス", 4200), ("ナイキ", 3800), ("プーマ", 3000)]), target=TARGET, remove_outliers=False)
    assert one(j.quotes).basis_tier == "all"
    assert any("参考程度" in w for w in one(j.warnings).warnings)


def test_outliers_only_within_basis(job):
    entries = [(f"ノースフェイス ND91841 {i}", 17000 + i * 100) for i in range(9)]
    entries += [("ノースフェイス ND91841 バグ", 400000), ("アディダス ジャージ", 4200)]
    j = job(tiered(entries), target=TARGET)
    assert one(j.source_stats).outlier_count == 1
    status = {r.price: r.status for r in j.rows.collect()}
    assert status[400000] == "外れ値(IQR)" and status[4200] == "相場の対象外" and status[17000] == "使用"


def test_thin_sources_are_said(job):
    j = job(rows_of("yahoo", [1000, 2000]) + rows_of("mercari", [5000, 6000]))
    assert one(j.warnings).warnings == ["件数が少ないため相場の信頼度は低めです: ヤフオク / メルカリ"]


def test_summary_statistics(job):
    s = one(job(rows_of("yahoo", [1000, 2000, 3000, 4000, 5000])).source_stats)
    got = [s[n] for n in stats.STAT_NAMES]
    assert got == [5, 1000, 2000, 3000, 4000, 5000, 3000, 1581, 2000]
    assert one(job(rows_of("yahoo", [5000])).source_stats).stdev == 0


def half_up(x):
    return int((x + 0.5) // 1)


def brute(prices):
    """Percentile by sorting, for the random check below."""
    v = sorted(prices)

    def at(q):
        pos = (len(v) - 1) * q
        lo = int(pos)
        hi = min(lo + 1, len(v) - 1)
        return v[lo] + (v[hi] - v[lo]) * (pos - lo)

    return v, at


def test_random_prices_against_sorting(job):
    rng = random.Random(7)
    rows, kept = [], {}
    for k in range(25):
        prices = [rng.choice([rng.randint(300, 2000), 900, 40000]) for _ in range(rng.randint(1, 40))]
        rows += rows_of("yahoo", prices, quote=f"q{k}")
        v, at = brute(prices)
        if len(v) >= 8 and at(0.75) > at(0.25):
            spread = at(0.75) - at(0.25)
            inside = [p for p in v if at(0.25) - 1.5 * spread <= p <= at(0.75) + 1.5 * spread]
            v = inside or v
        kept[f"q{k}"] = v
    j = job(rows)
    got = {r.quote_id: r for r in j.quotes.collect()}
    pooled = {r.quote_id: r for r in j.pooled_stats.collect()}
    for quote, v in kept.items():
        _, at = brute(v)
        spread = half_up(statistics.stdev(v)) if len(v) > 1 else 0
        want = (len(v), v[0], half_up(at(0.25)), half_up(at(0.5)), half_up(at(0.75)), v[-1],
                half_up(sum(v) / len(v)), spread)
        r = got[quote]
        assert want == (r.combined_count, r.combined_min, r.combined_p25, r.combined_median, r.combined_p75,
                        r.combined_max, r.combined_mean, r.combined_stdev)
        p = pooled[quote]
        assert want == tuple(p[n] for n in stats.STAT_NAMES[:-1])
    assert sum(r.n for r in j.histogram.collect()) == sum(len(v) for v in kept.values())


def test_order_of_rows_does_not_matter(job):
    rows = rows_of("yahoo", [3000, 1000, 2000, 5000])
    assert one(job(rows).quotes) == one(job(rows[::-1]).quotes)


def test_histogram_bounds(job):
    j = job(rows_of("yahoo", [1000, 2000, 9000]) + rows_of("mercari", [1500, 8000]))
    bins = j.histogram.collect()
    assert sum(r.n for r in bins) == 5
    assert min(r.lo for r in bins) <= 1000 and max(r.hi for r in bins) >= 9000
    assert {r.source for r in bins} == {"yahoo", "mercari"}
    assert len({(r.lo, r.hi) for r in bins}) * 2 == len(bins)


def test_histogram_of_one_price_and_fixed_bins(job):
    j = job(rows_of("yahoo", [5000, 5000]))
    bar = one(j.histogram)
    assert (bar.lo, bar.hi, bar.n) == (5000, 5500, 2)
    j = job(rows_of("yahoo", [1000, 2000, 3000, 4000, 5000]))
    assert len(histogram.stacked(j.settled, bins=4).collect()) == 5


def test_paste_path_and_unreadable_source(spark):
    pastes = spark.createDataFrame([
        ("a", "yahoo", "ヌプシ A\n落札 9,800円\nヌプシ B\n落札 11,200円\nヌプシ C\n落札 10,500円"),
        ("a", "mercari", "¥13,800\nヌプシ D\n¥12,400\nヌプシ E\n¥14,000\nヌプシ F"),
        ("b", "yahoo", "ノースフェイス ヌプシ\nパタゴニア レトロX"),
        ("b", "mercari", "¥13,800\nヌプシ C\n¥12,400\nヌプシ D"),
        ("c", "yahoo", ""),
    ], "quote_id string, source string, text string")
    options = spark.createDataFrame([("a", "ヌプシ"), ("b", "ヌプシ"), ("c", "ヌプシ")], "quote_id string, query string")
    entries = spark.createDataFrame([("c", "mercari", 0, "ヌプシ", 7000)],
                                    "quote_id string, source string, pos bigint, title string, price bigint")
    j = quotes_from_pastes(pastes, options, entries=entries, sources=SOURCES)
    got = {r.quote_id: r for r in j.quotes.collect()}
    assert (got["a"].equal_weight_median, got["b"].combined_count, got["c"].combined_median) == (12150, 2, 7000)
    warned = {r.quote_id: r.warnings for r in j.warnings.collect()}
    assert warned["b"][0].startswith("ヤフオク: 貼り付けたテキストから")
    cards = {(r.quote_id, r.source): r for r in j.cards.collect()}
    assert cards["b", "yahoo"].error and cards["b", "mercari"].used == 2


def test_shown_rows(job):
    rows = views.shown_rows(job(rows_of("yahoo", [5000, 1000, 3000])).rows, sort_key="price", descending=True, limit=2)
    assert [r.price for r in rows.orderBy("place").collect()] == [5000, 3000]
    by_title = views.shown_rows(job(rows_of("yahoo", [5000])).rows.withColumn("title", F.lit(None).cast("string")),
                                sort_key="title")
    assert by_title.count() == 1


def test_long_item_ids_are_not_cut(job):
    rows = [("q", "yahoo", 7, "x", 5000), ("q", "yahoo", 123456, "x", 5000)]
    assert {r.item_id for r in job(rows).rows.collect()} == {"yahoo-0007", "yahoo-123456"}


def test_listings_and_quotes_without_options(spark):
    listings = spark.createDataFrame(
        [("bare", "yahoo", i, "手袋", p) for i, p in enumerate([700, 900, None, 100])] + [("crossed", "yahoo", 0, "手袋", 800)],
        "quote_id string, source string, pos bigint, title string, price bigint")
    options = spark.createDataFrame([("empty", "x", None, None), ("crossed", "x", 9, 5)],
                                    "quote_id string, query string, price_min bigint, price_max bigint")
    targets = spark.createDataFrame([("wanted", "ナイキ", None)], "quote_id string, brand string, model_numbers array<string>")
    job = QuoteJob(listings, options, targets, sources=SOURCES)
    quotes = {r.quote_id: r for r in job.quotes.collect()}
    assert {k: q.combined_count for k, q in quotes.items()} == {"bare": 2, "empty": 0, "wanted": 0}
    assert quotes["wanted"].has_target and quotes["wanted"].sources_used == []
    warned = {r.quote_id: r.warnings for r in job.warnings.collect()}
    assert len(warned["empty"]) == 1 and "貼り付けて" in warned["empty"][0] and len(warned["wanted"]) == 2
    assert [r.quote_id for r in job.rejects.collect()] == ["crossed"]
    assert {(r.quote_id, r.source) for r in job.source_stats.collect()} == {("bare", "yahoo")}
    rows = {r.pos: r for r in job.rows.collect()}
    assert not rows[2].in_basis and rows[2].status == rows[3].status and "下限価格" in rows[2].status
    assert sum(r.in_basis for r in rows.values()) == sum(r["count"] for r in job.source_stats.collect()) == 2


def test_pages_entries_and_one_row_per_source(spark):
    pastes = spark.createDataFrame(
        [("q", "yahoo", 1, "¥700\n手袋B"), ("q", "yahoo", 0, "¥600\n手袋A\n¥650\n手袋C"), ("q", "mercari", 0, "つながりません")],
        "quote_id string, source string, page int, text string")
    entries = spark.createDataFrame([("q", "yahoo", 0, "手袋D", 800), ("q", "mercari", 0, "手袋E", 900)],
                                    "quote_id string, source string, pos bigint, title string, price bigint")
    options = spark.createDataFrame([("q", "x")], "quote_id string, query string")
    job = quotes_from_pastes(pastes, options, entries=entries, sources=SOURCES, page="page")
    ids = {r.item_id: r.title for r in job.rows.collect()}
    assert ids == {"yahoo-0000": "手袋A", "yahoo-0001": "手袋C", "yahoo-0002": "手袋B", "yahoo-0003": "手袋D", "mercari-0000": "手袋E"}
    cards = {r.source: r for r in job.cards.collect()}
    assert len(cards) == 2 and cards["mercari"].error is None and cards["yahoo"].read == 4


def test_stored_counts_give_the_same_results(job, tmp_path):
    j = job(rows_of("yahoo", [5000, 5100, 5200, 5300, 90000]) + rows_of("mercari", [4000, 6000]))
    j.store_counts(str(tmp_path / "counts"))
    stored = j.with_counts(str(tmp_path / "counts"))
    assert stored.quotes.collect() == j.quotes.collect()
    assert sorted(stored.rows.collect()) == sorted(j.rows.collect())


def test_rows_beyond_the_group_limit_and_ties(job, monkeypatch):
    rows = rows_of("mercari", [500 + i % 3 for i in range(40)]) + rows_of("yahoo", [500 + i % 3 for i in range(40)])
    frame = job(rows).rows
    want = [(r.item_id, r.place) for r in views.shown_rows(frame, limit=30, sources=SOURCES).collect()]
    assert want[0] == ("yahoo-0000", 1) and want[1] == ("yahoo-0003", 2)
    monkeypatch.setattr(views, "GROUP_LIMIT", 5)
    got = [(r.item_id, r.place) for r in views.shown_rows(frame, limit=30, sources=SOURCES).collect()]
    assert sorted(got) == sorted(want)


def test_both_ways_to_find_models_agree(spark):
    from pricetide.operators import match
    titles = spark.createDataFrame([("コートAB12345",), ("XY99999コート",), ("AB1234",), ("",)], "title string")
    models = ["AB12345", "XY99999"]
    few = F.array(*[F.lit(m) for m in models])
    many = F.array(*[F.lit(m) for m in models + [f"QQ{i:05d}" for i in range(40)]])
    lengths, starts = F.array(F.lit(7)), F.array(F.lit("AB"), F.lit("XY"), F.lit("QQ"))
    got = titles.select(*[match._holds_model(F.col("title"), m, lengths, starts).alias(n) for n, m in (("few", few), ("many", many))]).collect()
    assert [r.few for r in got] == [r.many for r in got] == [True, True, False, False]


def test_counts_of_pages_need_no_positions(spark):
    pages = spark.createDataFrame(
        [(1, "auction", p, "\n".join(f"¥{1000 + 10 * p + i}\nコート{p}{i}番" for i in range(3))) for p in range(4)],
        "quote_id int, source string, page int, text string")
    options = spark.createDataFrame([(1, "コート")], "quote_id int, query string")
    job = quotes_from_pastes(pages, options, sources=SOURCES, page="page")
    plan = job.counted._jdf.queryExecution().optimizedPlan().toString()
    assert "page_key" not in plan  # numbering pages on parses all of them once more and joins them
    assert job.quotes.first()["combined_count"] == 12
    assert sorted(r["item_id"] for r in job.rows.collect()) == [f"auction-{i:04d}" for i in range(12)]
