import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricetide.functions.pairing import nearest_of_pages, nearest_titles
from pricetide.operators import parse
from pricetide.plans.replay import quotes_from_pastes

AUCTION = """検索結果 88件
カンタベリー ラガーシャツ 長袖 XL 紺
即決 7,400円
落札 3,150円
2025年4月12日
ミズノ ウインドブレーカー S 白
落札 2,600円
2025年4月9日"""

MARKET = """¥4,480
アシックス ランニングパンツ M
送料込み
SOLD
¥1,980
プーマ 半袖シャツ L
送料込み"""


@pytest.fixture(scope="module")
def parsed(spark):
    """Parse several texts in one job."""
    def run(texts):
        df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
        return parse.parse_pastes(df).orderBy("k").collect()

    return run


def pairs(row):
    return [(e.price, e.title) for e in row.entries]


def test_extract_price(column_values):
    lines = ["¥3,450", "3,450円", "3450円", "送料無料", "即決 7,400円 落札 3,150円", "1円から 現在 3,150円",
             "¥2", "落札 価格は別 ¥2,200", f"¥{'8' * 30} ¥640"]
    # an amount beyond 64 bits is kept as the largest there is, and the ceiling excludes it later
    assert column_values(parse.extract_price, lines) == [3450, 3450, 3450, None, 3150, 3150, 2, 2200, parse.HUGE]


CASES = {
    "auction": (AUCTION, "flow", [(3150, "カンタベリー ラガーシャツ 長袖 XL 紺"), (2600, "ミズノ ウインドブレーカー S 白")]),
    "inline": ("アシックス ウォームアップ上下 L 5,900円 2025年4月12日\nプーマ パーカー M ¥3,300 2025/04/09", "flow",
               [(5900, "アシックス ウォームアップ上下 L"), (3300, "プーマ パーカー M")]),
    "number in title": ("ミズノ ジャージ 3000 1988年発売\n落札 6,200円", "flow", [(6200, "ミズノ ジャージ 3000 1988年発売")]),
    "one yen start": ("カンタベリー ラガーシャツ 1円から\n落札 3,150円", "flow", [(3150, "カンタベリー ラガーシャツ 1円から")]),
    "market": (MARKET, "flow", [(4480, "アシックス ランニングパンツ M"), (1980, "プーマ 半袖シャツ L")]),
    "each title once": ("¥610\n手袋A\n¥720\n手袋B\n¥830\n手袋C", "flow", [(610, "手袋A"), (720, "手袋B"), (830, "手袋C")]),
    "csv": ("品名,金額\nアシックス 手袋 L,1450\nプーマ 帽子 M,2350", "table", [(1450, "アシックス 手袋 L"), (2350, "プーマ 帽子 M")]),
    "tsv": ("アシックス 手袋 L\t1,450円\nプーマ 帽子 M\t2,350円", "table", [(1450, "アシックス 手袋 L"), (2350, "プーマ 帽子 M")]),
    "quoted thousands": ('"手袋 A","1,450"\n"手袋 B","2,350"', "table", [(450, "手袋 A"), (350, "手袋 B")]),
    "bare": ("1450\n2350\n980", "flow", [(1450, ""), (2350, ""), (980, "")]),
    "bare beside marked": ("ミズノ ジャージ\n3000\n¥6,200", "flow", [(6200, "ミズノ ジャージ")]),
    "empty": ("  \n \n", "flow", []),
    "null": (None, "flow", []),
    "no price": ("アシックス 手袋\nプーマ 帽子", "flow", []),
    "full width": ("プーマ Ｍサイズ\n￥３，３００", "flow", [(3300, "プーマ Mサイズ")]),
    "titles run out": ("手袋A\n¥610\n¥720", "flow", [(610, "手袋A"), (720, "手袋A")]),
    "windows lines": ("手袋A\r\n\t¥610 \r\n", "flow", [(610, "手袋A")]),
    "huge": ("手袋A\n¥" + "7" * 25, "flow", [(parse.HUGE, "手袋A")]),
}


def test_pastes(parsed):
    rows = parsed([text for text, _, _ in CASES.values()])
    for (name, (_, mode, want)), row in zip(CASES.items(), rows):
        assert (row.mode, pairs(row)) == (mode, want), name
    by_name = dict(zip(CASES, rows))
    assert by_name["bare"].untitled == 3 and by_name["auction"].untitled == 0
    assert "送料込み" in by_name["market"].ignored_samples
    assert by_name["empty"].lines == 0 and by_name["empty"].error is None
    assert by_name["no price"].prices_found == 0 and "読み取れませんでした" in by_name["no price"].error


def test_entries_and_direct_report(spark, parsed):
    df = spark.createDataFrame([(1, "¥610\n手袋A\n¥720\n手袋B"), (2, "")], "k int, text string")
    got = parse.entries(parse.parse_pastes(df)).orderBy("pos").collect()
    assert [tuple(r) for r in got] == [(1, 0, "手袋A", 610), (1, 1, "手袋B", 720)]
    direct = spark.createDataFrame([("q", "s", 1), ("q", "s", 2)], "quote_id string, source string, price int")
    row = parse.direct_report(direct).first()
    assert (row.mode, row.lines, row.prices_found, row.untitled) == ("direct", 2, 2, 0)


def plain_choice(prices, titles):
    used, out = set(), []
    for line in prices:
        best = min(range(len(titles)), key=lambda k: (k in used, abs(titles[k] - line), titles[k] > line), default=-1)
        used.add(best)
        out.append(best)
    return out


def test_nearest_titles_against_plain_search():
    rng = random.Random(3)
    for _ in range(600):
        lines = rng.sample(range(40), rng.randint(0, 24))
        prices = sorted(lines[: rng.randint(0, len(lines))])
        titles = sorted(set(lines) - set(prices) | set(rng.sample(prices, len(prices) // 3)))
        assert nearest_titles(prices, titles) == plain_choice(prices, titles)


def test_large_page_is_linear(spark):
    text = "\n".join(f"¥{1000 + i}\nコート{i}番" for i in range(20000))
    df = spark.createDataFrame([(1, text)], "k int, text string")
    last = parse.entries(parse.parse_pastes(df)).orderBy(F.desc("pos")).first()
    assert (last.pos, last.title, last.price) == (19999, "コート19999番", 20999)


def test_pages_are_numbered_on(spark):
    rng = random.Random(5)
    rows = []
    for q, s in ((1, "a"), (1, "b"), (None, "a"), (1, None), (2, "a")):
        for page in [None, 3, 3, *rng.sample(range(10), 4)]:
            first = rng.randint(1000, 9000)
            rows.append((q, s, page, "\n".join(f"¥{first + i}\nコート{first + i}番" for i in range(rng.randint(0, 4)))))
    parsed = parse.parse_pastes(spark.createDataFrame(rows, "quote_id int, source string, page int, text string"))
    started = parse.page_starts(parsed, "page")
    plan = started._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1  # the side that counts pairs no titles
    got = started.collect()
    assert len(got) == len(rows)
    for r in got:
        def order(x):
            return (x.page is not None, x.page or 0, [tuple(e) for e in x.entries])

        group = [x for x in got if (x.quote_id, x.source) == (r.quote_id, r.source)]
        assert r.start in {sum(x.prices_found for x in group if order(x) < order(r))}
        assert r.prices_found == len(r.entries)


def test_empty_text_meets_no_cast(spark):
    """A failing cast in a lambda throws each time, so titles without an amount were slower than all the rest."""
    df = spark.createDataFrame([(1, "手袋 A,120\n手袋 B,4500\nx,0"), (2, "手袋 A\n¥610"), (3, "手袋,+" + "9" * 30 + "\n帽子,-" + "9" * 30)], "k int, text string")
    rows = parse.parse_pastes(df).orderBy("k").collect()
    assert [pairs(r) for r in rows] == [
        [(120, "手袋 A"), (4500, "手袋 B")], [(610, "手袋 A")], [(parse.HUGE, "手袋"), (-parse.HUGE, "帽子")]]
    plan = df.select(parse._whole(F.col("text")))._jdf.queryExecution().analyzed().toString().lower()
    assert plan.index("case when") < plan.index("cast(")


def test_line_alone_in_a_stated_table(spark):
    df = spark.createDataFrame([(1, "手袋 A\t90円"), (2, "手袋 A\t90円\n帽子 B\t1,450円"), (3, "")], "k int, text string")
    seen = parse.parse_pastes(df).orderBy("k").collect()
    stated = parse.parse_pastes(df, tables=True).orderBy("k").collect()
    assert [pairs(r) for r in seen] == [[], [(90, "手袋 A"), (1450, "帽子 B")], []]
    assert [pairs(r) for r in stated] == [[(90, "手袋 A")], [(90, "手袋 A"), (1450, "帽子 B")], []]


def test_pages_at_once_take_the_titles_of_the_greedy_choice():
    random.seed(5)
    for _ in range(300):
        kinds = [random.choices("ptx", k=random.choice([0, 1, 3, 9, 30])) for _ in range(random.randint(1, 6))]
        prices, titles = ([np.array([i for i, k in enumerate(page) if k == kind], np.int64) for page in kinds] for kind in "pt")
        want = [nearest_titles(p.tolist(), t.tolist()) for p, t in zip(prices, titles)]
        assert [page.tolist() for page in nearest_of_pages(prices, titles)] == want


def test_untitled_is_counted_without_pairing_and_titles_are_taken_one_by_one(spark):
    texts = [MARKET, "¥4,480\n¥1,980", "¥500\nアシックス\n¥700\n¥900", "紺のシャツ,1200\n980,円\n1,500円\t2", ""]
    parsed = parse.parse_pastes(spark.createDataFrame(list(enumerate(texts)), "k int, text string"))
    counted = parsed.select("k", "untitled")
    assert "ArrowEvalPython" not in counted._jdf.queryExecution().optimizedPlan().toString()
    # the array of all titles, once for every price, would cost a page the square of its length
    assert not re.search(r"titles#\d+\.title", parsed._jdf.queryExecution().analyzed().toString())
    held = parsed.select("k", F.size(F.filter("entries", lambda e: e["title"] == "")).alias("untitled"))
    assert sorted(counted.collect()) == sorted(held.collect())


def test_kept_pages_are_parsed_once(spark):
    pages = spark.createDataFrame(
        [(1, "auction", 0, AUCTION), (1, "market", 0, MARKET), (1, "market", 1, "¥700\n¥900"), (2, "market", 0, "売り切れ")],
        "quote_id bigint, source string, page bigint, text string")
    options = spark.createDataFrame([(1, "紺"), (2, "紺")], "quote_id bigint, query string")
    plain, kept = (quotes_from_pastes(pages, options, page="page", keep_pages=keep) for keep in (False, True))
    for result in ("cards", "warnings", "rows"):
        assert sorted(getattr(plain, result).collect(), key=repr) == sorted(getattr(kept, result).collect(), key=repr)
        plan = getattr(kept, result)._jdf.queryExecution().optimizedPlan().toString()
        assert "text#" not in plan and "ArrowEvalPython" not in plan
