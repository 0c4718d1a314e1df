"""The registered queries in SQL for DuckDB, over the same tables."""

from __future__ import annotations

from pricetide import dims
from pricetide.functions import text as tx
from pricetide.sources import dictionary

# --- derived inputs ------------------------------------------------------------------------------

LISTINGS = """
fx_listings AS (
  SELECT quote_id, source,
         row_number() OVER (PARTITION BY quote_id, source
                            ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS pos,
         title, price
  FROM (
    SELECT l_suppkey AS quote_id, l_orderkey, l_linenumber, l_partkey, l_extendedprice,
      CASE WHEN l_suppkey % 11 = 3 OR l_linestatus = 'O' THEN 'auction' ELSE 'market' END AS source,
      p_brand || ' ' || p_name || ' MD' || lpad(CAST(p_partkey AS STRING), 5, '0') ||
        CASE l_orderkey % 37 WHEN 0 THEN ' まとめ売り' WHEN 1 THEN ' 3枚セット' WHEN 2 THEN ' セットアップ'
          WHEN 3 THEN ' ジャンク' WHEN 4 THEN ' キッズ' WHEN 5 THEN ' カタログ' WHEN 6 THEN ' タグのみ'
          WHEN 7 THEN ' レプリカ' ELSE '' END AS title,
      CAST(floor(CASE WHEN l_orderkey % 53 = 0 THEN l_extendedprice / 100
                      WHEN l_orderkey % 59 = 0 THEN l_extendedprice * 100
                      WHEN l_orderkey % 61 = 0 THEN l_extendedprice * 5
                      ELSE l_extendedprice END) AS BIGINT) AS price
    FROM lineitem JOIN part ON p_partkey = l_partkey
  ) x
)"""

OPTIONS = """
fx_options AS (
  SELECT s_suppkey AS quote_id,
         CASE s_suppkey % 5 WHEN 0 THEN 'キッズ widget' WHEN 1 THEN 'まとめ売り' ELSE 'widget' END AS query,
         CASE WHEN s_suppkey % 4 = 1 THEN 5000 ELSE 300 END AS price_min,
         CASE WHEN s_suppkey % 4 = 2 THEN 90000 ELSE 3000000 END AS price_max,
         s_suppkey % 3 = 0 AS has_words,
         s_suppkey % 13 <> 5 AS defaults_on,
         s_suppkey % 9 <> 4 AS remove_outliers
  FROM supplier
)"""

TARGETS = """
fx_targets AS (
  SELECT s_suppkey AS quote_id,
         CASE WHEN s_suppkey % 7 = 0 THEN NULL WHEN s_suppkey % 7 = 1 THEN 'NoSuchBrand' ELSE p_brand END AS brand
  FROM supplier JOIN part ON p_partkey = s_suppkey
),
fx_models AS (
  SELECT s_suppkey AS quote_id, 'MD' || lpad(CAST(p_partkey AS STRING), 5, '0') AS model
  FROM supplier JOIN part ON p_partkey % (SELECT count(*) FROM supplier) = s_suppkey
  WHERE s_suppkey % 7 > 1
),
terms AS (
  SELECT o.*, t.brand, t.quote_id IS NOT NULL AND (t.brand IS NOT NULL OR m.quote_id IS NOT NULL) AS has_target
  FROM fx_options o LEFT JOIN fx_targets t USING (quote_id)
  LEFT JOIN (SELECT DISTINCT quote_id FROM fx_models) m USING (quote_id)
)"""

DEFAULT_TERMS = """
terms AS (
  SELECT s_suppkey AS quote_id, 'widget ' || s_suppkey AS query, 300 AS price_min, 3000000 AS price_max,
         false AS has_words, true AS defaults_on, true AS remove_outliers, CAST(NULL AS VARCHAR) AS brand,
         s_suppkey % 2 = 0 AS has_target
  FROM supplier
),
fx_models AS (
  SELECT s_suppkey AS quote_id, 'MD' || lpad(CAST(s_suppkey AS STRING), 5, '0') AS model
  FROM supplier WHERE s_suppkey % 2 = 0
)"""


def _rule(rule: int, text: str) -> str:
    words, _ = dims.EXCLUSION_RULES[rule]
    if words == [dims.SET_WORD]:
        return f"contains(replace({text}, '{dims.SUIT_WORD}', '#'), '{dims.SET_WORD}')"
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _reason() -> str:
    rules = "\n".join(
        f"WHEN defaults_on AND NOT {_rule(i, 'query')} AND {_rule(i, 'l.title')} THEN '{why}'"
        for i, (_, why) in enumerate(dims.EXCLUSION_RULES)
    )
    return f"""CASE
      WHEN price IS NULL OR price < price_min THEN '下限価格(' || format('{{:,}}', price_min) || '円)未満'
      WHEN price > price_max THEN '上限価格(' || format('{{:,}}', price_max) || '円)超'
      {rules}
      WHEN has_words AND contains(lower(l.title), 'hot') THEN '除外語: HOT'
      WHEN has_words AND contains(lower(l.title), 'old') THEN '除外語: old' END"""


CLASSIFIED = f"""
classified AS (
  SELECT l.*, o.has_target, o.remove_outliers, {_reason()} AS exclude_reason,
    CASE WHEN NOT o.has_target THEN 'loose'
         WHEN m.hit THEN 'model'
         WHEN o.brand IS NOT NULL AND contains(upper(l.title), upper(o.brand)) THEN 'brand' ELSE 'loose' END AS tier
  FROM fx_listings l JOIN terms o USING (quote_id)
  LEFT JOIN (
    SELECT t.quote_id, t.title, bool_or(contains(replace(upper(t.title), ' ', ''), x.model)) AS hit
    FROM (SELECT DISTINCT quote_id, title FROM fx_listings) t JOIN fx_models x USING (quote_id)
    GROUP BY 1, 2
  ) m ON m.quote_id = l.quote_id AND m.title = l.title
)"""

SETTLED = """
basis AS (
  SELECT *, CASE basis_tier WHEN 'model' THEN n_model WHEN 'brand' THEN n_model + n_brand
                            ELSE n_model + n_brand + n_loose END AS n_basis
  FROM (
    SELECT *, CASE WHEN NOT has_target THEN 'all' WHEN n_model >= 3 THEN 'model'
                   WHEN n_model + n_brand >= 3 THEN 'brand' ELSE 'all' END AS basis_tier
    FROM (
      SELECT quote_id, bool_or(has_target) AS has_target,
        count(*) FILTER (exclude_reason IS NULL AND tier = 'model') AS n_model,
        count(*) FILTER (exclude_reason IS NULL AND tier = 'brand') AS n_brand,
        count(*) FILTER (exclude_reason IS NULL AND tier = 'loose') AS n_loose
      FROM classified GROUP BY quote_id
    ) a
  ) b
),
candidates AS (
  SELECT c.*, b.basis_tier,
    exclude_reason IS NULL AND (basis_tier = 'all' OR tier = 'model' OR (basis_tier = 'brand' AND tier = 'brand'))
      AS candidate
  FROM classified c JOIN basis b USING (quote_id)
),
quartiles AS (
  SELECT quote_id, source, any_value(basis_tier) AS basis, bool_or(remove_outliers) AS remove_outliers,
    count(*) FILTER (candidate) AS n,
    quantile_cont(price, 0.25) FILTER (candidate) AS q1, quantile_cont(price, 0.75) FILTER (candidate) AS q3
  FROM candidates GROUP BY 1, 2
),
raw_fences AS (
  SELECT quote_id, source, basis,
    CASE WHEN remove_outliers AND n >= 8 AND q3 > q1 THEN q1 - 1.5 * (q3 - q1) END AS low,
    CASE WHEN remove_outliers AND n >= 8 AND q3 > q1 THEN q3 + 1.5 * (q3 - q1) END AS high
  FROM quartiles
),
fences AS (
  SELECT f.quote_id, f.source, f.basis,
    CASE WHEN c.inside > 0 THEN low END AS low, CASE WHEN c.inside > 0 THEN high END AS high
  FROM raw_fences f JOIN (
    SELECT x.quote_id, x.source, count(*) FILTER (candidate AND price BETWEEN low AND high) AS inside
    FROM candidates x JOIN raw_fences y ON x.quote_id = y.quote_id AND x.source = y.source GROUP BY 1, 2
  ) c ON c.quote_id = f.quote_id AND c.source = f.source
),
final AS (
  SELECT c.*, coalesce(candidate AND (price < low OR price > high), false) AS outlier,
    candidate AND NOT coalesce(price < low OR price > high, false) AS kept
  FROM candidates c JOIN fences f ON f.quote_id = c.quote_id AND f.source = c.source
)"""

BASE = f"WITH {LISTINGS},{OPTIONS},{TARGETS},{CLASSIFIED},{SETTLED}"
REPLAYED = f"WITH {LISTINGS},{DEFAULT_TERMS},{CLASSIFIED},{SETTLED}"


def _half_up(value: str) -> str:
    return f"CAST(floor({value} + 0.5) AS BIGINT)"


def _stats(prefix: str = "") -> str:
    quantiles = ", ".join(
        f"{_half_up(f'quantile_cont(price, {q}) FILTER (kept)')} AS {prefix}{name}"
        for name, q in (("p25", 0.25), ("median", 0.5), ("p75", 0.75))
    )
    return f"""count(*) FILTER (kept) AS {prefix}count, min(price) FILTER (kept) AS {prefix}min, {quantiles},
      max(price) FILTER (kept) AS {prefix}max, {_half_up('avg(price) FILTER (kept)')} AS {prefix}mean,
      CASE WHEN count(*) FILTER (kept) = 1 THEN 0
           ELSE {_half_up('stddev_samp(price) FILTER (kept)')} END AS {prefix}stdev,
      {_half_up('quantile_cont(price, 0.75) FILTER (kept)')}
        - {_half_up('quantile_cont(price, 0.25) FILTER (kept)')} AS {prefix}iqr"""


SOURCE_STATS = f"""
source_stats AS (
  SELECT quote_id, source, count(*) AS n_read,
    count(*) FILTER (exclude_reason IS NOT NULL OR outlier) AS excluded_count,
    count(*) FILTER (outlier) AS outlier_count, {_stats()}
  FROM final GROUP BY 1, 2
)"""

QUOTES = f"""
pooled AS (SELECT quote_id, {_stats('combined_')} FROM final GROUP BY 1),
blend AS (
  SELECT quote_id,
    {_half_up('avg(median) FILTER (count > 0)')} AS equal_weight_median,
    {_half_up('avg(mean) FILTER (count > 0)')} AS equal_weight_mean,
    coalesce(string_agg(source, ',' ORDER BY source) FILTER (count > 0), '') AS sources_used
  FROM source_stats GROUP BY 1
),
quotes AS (
  SELECT quote_id, basis_tier, has_target, n_model, n_brand, n_loose, n_basis, equal_weight_median,
    equal_weight_mean, combined_mean AS weighted_mean, sources_used, combined_count, combined_min, combined_p25,
    combined_median, combined_p75, combined_max, combined_mean, combined_stdev, combined_iqr
  FROM basis JOIN blend USING (quote_id) JOIN pooled USING (quote_id)
)"""

QUOTED = f"{BASE},{SOURCE_STATS},{QUOTES}"

MIXED_INPUTS = f"""
{LISTINGS.replace('fx_listings AS', 'raw_listings AS')},
fx_listings AS (
  SELECT quote_id, source, pos, title,
         CASE WHEN source = 'market' AND quote_id % 8 = 0 AND pos = 0 THEN NULL ELSE price END AS price
  FROM raw_listings WHERE source = 'market' OR quote_id % 4 IN (0, 3)
),
{OPTIONS.replace('fx_options AS', 'given_options AS')},
fx_options AS (
  SELECT quote_id, CASE WHEN quote_id % 3 = 0 THEN '' ELSE query END AS query,
         CASE WHEN quote_id % 3 = 0 THEN 300 ELSE price_min END AS price_min,
         CASE WHEN quote_id % 3 = 0 THEN 3000000 ELSE price_max END AS price_max,
         has_words AND quote_id % 3 <> 0 AS has_words, defaults_on OR quote_id % 3 = 0 AS defaults_on,
         remove_outliers OR quote_id % 3 = 0 AS remove_outliers
  FROM given_options
),
ids AS (
  SELECT s_suppkey AS quote_id FROM supplier UNION ALL SELECT s_suppkey + 1000000 FROM supplier WHERE s_suppkey % 5 = 0
),
inputs AS (
  SELECT quote_id, source, CAST(NULL AS VARCHAR) AS error FROM fx_listings GROUP BY 1, 2
  UNION ALL
  SELECT s_suppkey, 'auction', CASE WHEN s_suppkey % 4 = 1 THEN '{dims.UNREADABLE_PASTE}' END
  FROM supplier WHERE s_suppkey % 4 IN (1, 2)
)"""
MIXED = f"WITH {MIXED_INPUTS},{TARGETS},{CLASSIFIED},{SETTLED},{SOURCE_STATS},{QUOTES}"

LABEL = "CASE {} WHEN 'auction' THEN 'オークション' ELSE 'フリマ' END"
TIER_LABEL = ("CASE {} WHEN 'model' THEN '品番まで一致' WHEN 'brand' THEN 'ブランドのみ一致' "
              "WHEN 'loose' THEN '手がかりなし' ELSE '全件' END")
ITEM_ID = "source || '-' || CASE WHEN pos < 10000 THEN lpad(CAST(pos AS VARCHAR), 4, '0') ELSE CAST(pos AS VARCHAR) END"


def _yen(value: str) -> str:
    return f"'¥' || format('{{:,}}', CAST({value} AS BIGINT))"


# --- histogram -----------------------------------------------------------------------------------

def _nice(raw: str) -> str:
    base = f"pow(10.0, floor(log10({raw})))"
    steps = " ".join(f"WHEN {m} * {base} >= {raw} THEN {m} * {base}" for m in ("1.0", "2.0", "2.5", "5.0"))
    return f"CASE WHEN {raw} <= 0 THEN 1 ELSE greatest(1, CAST(floor(CASE {steps} ELSE 10.0 * {base} END + 0.5) AS BIGINT)) END"


def _histogram(bins: str) -> str:
    return f"""
ranges AS (
  SELECT quote_id, count(*) AS n, min(price) AS lo, max(price) AS hi,
    quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3
  FROM final WHERE kept GROUP BY 1
),
raws AS (
  SELECT *, CASE WHEN lo = hi THEN CAST(greatest(1, floor(lo / 10)) AS DOUBLE) ELSE (hi - lo) / ({bins}) END AS raw FROM ranges
),
steps AS (SELECT *, {_nice('raw')} AS step FROM raws),
layout AS (
  SELECT *, CASE WHEN lo = hi THEN lo ELSE CAST(floor(lo / step) * step AS BIGINT) END AS first,
    CASE WHEN lo = hi THEN 1 ELSE CAST(floor(hi / step) - floor(lo / step) + 1 AS BIGINT) END AS bins
  FROM steps
),
slots AS (
  SELECT l.quote_id, s.source, l.first, l.step, CAST(b.bin AS INTEGER) AS bin
  FROM layout l
  JOIN (SELECT DISTINCT quote_id, source FROM final WHERE kept) s USING (quote_id),
  LATERAL (SELECT unnest(range(0, l.bins)) AS bin) b
),
placed AS (
  SELECT f.quote_id, f.source,
    CAST(least(l.bins - 1, greatest(0, floor((f.price - l.first) / l.step))) AS INTEGER) AS bin, count(*) AS n
  FROM final f JOIN layout l USING (quote_id) WHERE kept GROUP BY 1, 2, 3
),
hist AS (
  SELECT s.quote_id, s.source, s.bin, first + s.bin * step AS lo, first + (s.bin + 1) * step AS hi,
    coalesce(p.n, 0) AS n
  FROM slots s LEFT JOIN placed p ON p.quote_id = s.quote_id AND p.source = s.source AND p.bin = s.bin
)"""


SUGGESTED = """CASE WHEN n < 2 THEN 1 WHEN q3 - q1 <= 0 OR hi - lo <= 0 THEN greatest(1, least(8, n))
    ELSE greatest(8, least(20, ceil((hi - lo) / (2 * (q3 - q1) / cbrt(n))))) END"""

# --- verdict -------------------------------------------------------------------------------------

SHOP_TAGS = """
shop_tags AS (
  SELECT o_orderkey AS tag_id, o_orderkey % (SELECT count(*) FROM supplier) AS quote_id,
    CASE WHEN o_orderkey % 101 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(floor(o_totalprice / 3) AS BIGINT) END AS shop_price,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'new' WHEN '2-HIGH' THEN 'mint' WHEN '5-LOW' THEN 'worn'
      ELSE 'normal' END AS condition
  FROM orders
)"""


def _level(q: str) -> str:
    """Interpolated like the job does it, from the sorted list, so that ties round alike."""
    pos = f"((n - 1) * CAST({q} AS DOUBLE))"
    lo, hi = f"v[CAST(floor({pos}) AS BIGINT) + 1]", f"v[CAST(ceil({pos}) AS BIGINT) + 1]"
    return f"CASE WHEN {lo} = {hi} THEN CAST({lo} AS DOUBLE) ELSE {lo} * (ceil({pos}) - {pos}) + {hi} * ({pos} - floor({pos})) END"


JUDGED = f"""
sorted AS (SELECT quote_id, list(price ORDER BY price) FILTER (kept) AS v, count(*) FILTER (kept) AS n FROM final GROUP BY 1),
levels AS (
  SELECT s.quote_id, n, {', '.join(f'CASE WHEN n > 0 THEN {_level(q)} END AS l{q[2:]}' for q in ('0.25', '0.3', '0.5', '0.65', '0.75', '0.8'))},
    coalesce(equal_weight_median, combined_median) AS anchor, basis_tier
  FROM sorted s JOIN quotes USING (quote_id)
),
below AS (
  SELECT t.tag_id, count(f.price) AS cheaper
  FROM shop_tags t LEFT JOIN (SELECT quote_id, price FROM final WHERE kept) f
    ON f.quote_id = t.quote_id AND f.price < t.shop_price
  GROUP BY 1
),
points AS (
  SELECT t.*, coalesce(l.n, 0) AS n, cheaper, basis_tier,
    t.shop_price > 0 AND coalesce(l.n, 0) >= 3 AS ok,
    CASE WHEN l5 > 0 THEN anchor * (CASE condition WHEN 'new' THEN l8 WHEN 'mint' THEN l65 WHEN 'worn' THEN l3 ELSE l5 END / l5)
         ELSE anchor END AS exact_target,
    l5, {_half_up('l75 - l25')} AS iqr
  FROM shop_tags t LEFT JOIN levels l USING (quote_id) JOIN below USING (tag_id)
),
rated AS (
  SELECT *, {_half_up('exact_target')} AS target0, {_half_up('l5')} AS median0 FROM points
),
scored AS (
  SELECT *, CASE WHEN target0 > 0 THEN shop_price / CAST(target0 AS DOUBLE) END AS r,
    CASE WHEN median0 > 0 THEN iqr / CAST(median0 AS DOUBLE) END AS spread0
  FROM rated
),
judged AS (
  SELECT *,
    CASE WHEN r IS NULL OR r <= 0.75 THEN 'bargain' WHEN r <= 0.92 THEN 'cheap' WHEN r <= 1.12 THEN 'fair'
         WHEN r <= 1.35 THEN 'pricey' ELSE 'overpriced' END AS band,
    CASE basis_tier WHEN 'model' THEN 2 WHEN 'brand' THEN 1 ELSE 0 END
      + CASE WHEN n >= 12 THEN 2 WHEN n >= 8 THEN 1 WHEN n >= 5 THEN 0 ELSE -1 END
      + CASE WHEN spread0 <= 0.5 AND n >= 8 THEN 1 WHEN spread0 > 1.0 THEN -1 ELSE 0 END AS score0
  FROM scored
),
sure AS (
  SELECT *, CASE WHEN n < 5 THEN 'low' WHEN score0 >= 4 AND basis_tier = 'model' THEN 'high'
                 WHEN score0 >= 2 THEN 'medium' ELSE 'low' END AS level0,
    CASE basis_tier WHEN 'model' THEN '{dims.WHY_MODEL}'
      WHEN 'brand' THEN '{dims.WHY_BRAND}'
      ELSE '{dims.WHY_ALL}' END AS why_tier,
    CASE WHEN n >= 12 THEN n || '{dims.WHY_MANY}' WHEN n >= 8 THEN n || '{dims.WHY_SOME}'
      WHEN n >= 5 THEN n || '{dims.WHY_FEW}' ELSE n || '{dims.WHY_TOO_FEW}' END AS why_n,
    CASE WHEN spread0 <= 0.5 AND n >= 8 THEN '{dims.WHY_TIGHT}'
      WHEN spread0 > 1.0 THEN '{dims.WHY_LOOSE}' END AS why_spread,
    CASE WHEN n >= 12 THEN 'good' WHEN n >= 8 THEN 'neutral' ELSE 'warning' END AS tone_n,
    CASE WHEN spread0 <= 0.5 AND n >= 8 THEN 'good' ELSE 'warning' END AS tone_spread,
    CASE band WHEN 'bargain' THEN 'good' WHEN 'cheap' THEN 'good' WHEN 'fair' THEN 'neutral'
      WHEN 'pricey' THEN 'warning' ELSE 'critical' END AS tone_band
  FROM judged
)"""

JUDGE = f"{QUOTED},{SHOP_TAGS},{JUDGED}"

LEVEL_LABEL = "CASE level0 WHEN 'high' THEN '高い' WHEN 'medium' THEN 'ふつう' ELSE '低い' END"

# --- tag text ------------------------------------------------------------------------------------

_ALIASES = ", ".join(
    "('{}', '{}', '{}', {})".format(*(s.replace("'", "''") for s in (name, alias, tx.fold_literal(alias))), order)
    for order, (name, alias) in enumerate(dictionary.ordered_aliases())
)
_SYMBOLS = tx.FOLD_SYMBOLS.replace("'", "''")
_STOP = ", ".join(f"'{w}'" for w in dims.STOP_WORDS)

TAGS = f"""
aliases(canonical, alias, folded, ord) AS (VALUES {_ALIASES}),
tags AS (
  SELECT p_partkey AS tag_id, p_name, p_partkey, p_size,
    CASE p_partkey % 5 WHEN 0 THEN 'THE NORTH FACE' WHEN 1 THEN 'patagonia' WHEN 2 THEN 'CARHARTT WIP'
      WHEN 3 THEN 'ユニクロ' ELSE 'ステンカラーコート' END || chr(10) ||
    'ND' || lpad(CAST(p_partkey AS STRING), 5, '0') || chr(10) ||
    CASE WHEN p_size % 2 = 0 THEN 'SIZE: ' || CASE p_size % 3 WHEN 0 THEN 'S' WHEN 1 THEN 'M' ELSE 'L' END
      ELSE CAST(70 + p_size AS STRING) END || chr(10) ||
    p_name || chr(10) || '表地 ナイロン100%' || chr(10) || 'MADE IN JAPAN' AS text
  FROM part
),
folded AS (
  SELECT *, trim(regexp_replace(translate(upper(text), '{_SYMBOLS}', '{' ' * len(tx.FOLD_SYMBOLS)}'), '\\s+', ' ', 'g')) AS folded
  FROM tags
),
branded AS (
  SELECT f.*, a.canonical AS brand, a.alias AS matched, a.folded AS brand_folded
  FROM folded f LEFT JOIN (
    SELECT x.tag_id, min(y.ord) AS ord FROM folded x JOIN aliases y ON contains(x.folded, y.folded) GROUP BY 1
  ) h USING (tag_id) LEFT JOIN aliases a ON a.ord = h.ord
),
read AS (
  SELECT *,
    'ND' || lpad(CAST(p_partkey AS STRING), 5, '0') AS model,
    CASE WHEN p_size % 2 = 0 THEN CASE p_size % 3 WHEN 0 THEN 'S' WHEN 1 THEN 'M' ELSE 'L' END
      ELSE CAST(70 + p_size AS STRING) END AS size,
    'ナイロン' AS material
  FROM branded
),
keyworded AS (
  SELECT *, list_filter(list_distinct_ordered, lambda w:
      length(w) >= 2 AND w NOT IN (model, size, material) AND w NOT IN ({_STOP})
      AND NOT regexp_matches(w, '[0-9%]')
      AND NOT list_contains(string_split(coalesce(brand_folded, ''), ' '), w)
      AND NOT list_contains(string_split(coalesce(upper(brand), ''), ' '), w)) AS keywords
  FROM (
    SELECT *, list_filter(string_split(folded, ' '), lambda w, i: list_position(string_split(folded, ' '), w) = i)
      AS list_distinct_ordered
    FROM read
  ) r
)"""

RESPONSES = """
answers AS (
  SELECT *, p_partkey % 25 = 1 AS blocked, p_partkey % 10 = 0 AS broken FROM part
),
hints AS (
  SELECT p_partkey AS tag_id,
    CASE WHEN blocked THEN 'blocked' WHEN broken THEN 'text_only' ELSE 'ok' END AS status,
    CASE WHEN blocked THEN '写真が受け付けられませんでした（SAFETY）。' END AS error,
    CASE WHEN blocked THEN NULL WHEN broken THEN '{ ' || p_name ELSE p_brand || chr(10) || p_name END AS text,
    CASE WHEN NOT blocked AND NOT broken AND p_partkey % 3 <> 0 THEN p_brand END AS brand,
    CASE WHEN NOT blocked AND NOT broken AND p_partkey % 2 = 0 THEN 'JAPAN' END AS made_in,
    CASE WHEN blocked OR broken THEN '' ELSE 'MD' || lpad(CAST(p_partkey AS STRING), 5, '0') END AS model_numbers,
    CASE WHEN blocked OR broken THEN '' ELSE CAST(p_size AS STRING) END AS sizes,
    CASE WHEN blocked OR broken THEN '' ELSE p_type END AS materials
  FROM answers
)"""


def _queries_sql(tail: str, noted: bool = False) -> str:
    labels = dims.QUERY_LABELS
    topic = "coalesce(array_to_string(keywords[1:2], ' '), '')"
    if noted:
        topic = f"CASE WHEN tag_id % 2 = 0 THEN '古着 BLUE' ELSE {topic} END"
    scanned = f"""SELECT tag_id, 0 AS o, CAST(4900000000000 + tag_id AS VARCHAR) AS query, '{labels["barcode"]}' AS label
  FROM parts WHERE tag_id % 3 = 0 UNION ALL """ if noted else ""
    return f"""WITH {TAGS},
parts AS (
  SELECT tag_id, coalesce(brand, '') AS b, model AS m, size AS s, {topic} AS t FROM keyworded
),
candidates AS (
  {scanned}SELECT tag_id, 1 AS o, b || ' ' || m AS query, '{labels["brand_model"]}' AS label FROM parts WHERE b <> ''
  UNION ALL SELECT tag_id, 2, m, '{labels["model"]}' FROM parts
  UNION ALL SELECT tag_id, 3, b || ' ' || t || ' ' || s, '{labels["brand_topic_size"]}' FROM parts WHERE b <> '' AND t <> ''
  UNION ALL SELECT tag_id, 4, b || ' ' || t, '{labels["brand_topic"]}' FROM parts WHERE b <> '' AND t <> ''
  UNION ALL SELECT tag_id, 5, t || ' ' || s, '{labels["topic_size"]}' FROM parts WHERE b = '' AND t <> ''
  UNION ALL SELECT tag_id, 6, b || ' ' || s, '{labels["brand_size"]}' FROM parts WHERE b <> ''
  UNION ALL SELECT tag_id, 7, b, '{labels["brand"]}' FROM parts WHERE b <> ''
  UNION ALL SELECT tag_id, 8, t, '{labels["topic"]}' FROM parts WHERE t <> ''
),
firsts AS (SELECT *, row_number() OVER (PARTITION BY tag_id, query ORDER BY o) AS dup FROM candidates),
ranked AS (
  SELECT tag_id, CAST(row_number() OVER (PARTITION BY tag_id ORDER BY o) AS INTEGER) AS rank, query, label
  FROM firsts WHERE dup = 1
) {tail}"""


# --- recognised text -----------------------------------------------------------------------------

_JP = r"[\x{3040}-\x{30FF}\x{3400}-\x{9FFF}ー々]"
_GOOD = r"[^0-9A-Za-z\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]"


SURE_LINE = "(length(line) * 7 + (i - 1) * 13) % 100 >= 30"


def _clean_docs(keep_line: str) -> str:
    return rf"""WITH split AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents
),
spaced AS (
  SELECT doc_id, i, regexp_replace(regexp_replace(regexp_replace(line, '\r$', ''), '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS line
  FROM split WHERE {keep_line}
),
joined AS (
  SELECT doc_id, i, regexp_replace(regexp_replace(line, '({_JP})[ \t]+({_JP})', '\1\2', 'g'),
    '({_JP})[ \t]+({_JP})', '\1\2', 'g') AS line
  FROM spaced
),
coded AS (
  SELECT doc_id, i, regexp_replace(regexp_replace(regexp_replace(line, '(\w)\s+-\s*(\d)', '\1-\2', 'g'),
    '(\d)\s*-\s+(\d)', '\1-\2', 'g'), '\b([A-Z]{{1,4}})\s+(\d{{3,7}})\b', '\1\2', 'g') AS line
  FROM joined
),
useful AS (
  SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY i) AS before
  FROM (
    SELECT *, length(regexp_replace(line, '{_GOOD}', '', 'g')) AS good,
      length(line) + length(regexp_replace(line, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')) AS size
    FROM coded
  ) x WHERE good >= 3 AND good * 2 >= size
),
texts AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS clean FROM useful
  WHERE before IS NULL OR before <> line GROUP BY 1
)
SELECT d.doc_id, CASE WHEN length(regexp_replace(coalesce(clean, ''), '{_GOOD}', '', 'g')) < 6 THEN ''
  ELSE coalesce(clean, '') END AS clean_text
FROM documents d LEFT JOIN texts USING (doc_id)"""


PAGED = f"WITH {LISTINGS}"


def _roundtrip(form: str) -> str:
    title = "'' AS title" if form == "bare" else "title"
    readable = " WHERE price >= 300" if form in ("auction", "inline") else ""
    # a page is a table when enough lines hold a comma that does not look like one grouping thousands
    alone = """ QUALIFY sum(CASE WHEN regexp_matches(title, '[0-9]$') AND price BETWEEN 100 AND 999 THEN 0 ELSE 1 END)
        OVER (PARTITION BY quote_id, source, pos // 20)
      >= greatest(2, ceil(count(*) OVER (PARTITION BY quote_id, source, pos // 20) / 2))""" if form == "csv" else ""
    return f"{PAGED} SELECT quote_id, source, pos // 20 AS page, {title}, price FROM fx_listings{readable}{alone}"


RECORDS = f"""
dated AS (
  SELECT o_orderkey % (SELECT count(*) FROM supplier) AS quote_id, max(o_orderdate) AS day FROM orders GROUP BY 1
),
saved AS (
  SELECT 'widget ' || q.quote_id AS query, CAST(epoch(day) AS BIGINT) + q.quote_id AS created, equal_weight_median,
    basis_tier AS tier, per_source
  FROM quotes q JOIN dated USING (quote_id) JOIN (
    SELECT quote_id, string_agg(concat_ws(':', source, median, count), '|' ORDER BY source) AS per_source
    FROM source_stats GROUP BY 1
  ) s USING (quote_id)
)"""


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}
    sql["quote_headline"] = f"{QUOTED} SELECT * FROM quotes"
    sql["quote_notes"] = f"""{QUOTED} SELECT quote_id, coalesce(equal_weight_median, combined_median) AS headline,
      {_yen('combined_p25')} || ' 〜 ' || {_yen('combined_p75')} AS usual_range, weighted_mean AS average,
      combined_count AS n, combined_min AS cheapest, combined_max AS dearest,
      CASE WHEN NOT has_target THEN '貼り付けた全 ' || n_basis || ' 件で計算しています。上の「1. 商品を特定する」でタグを読ませると、同じ品番の出品だけに絞れます。'
        ELSE {TIER_LABEL.format('basis_tier')} || 'の ' || n_basis || ' 件で計算（内訳: 品番まで一致 ' || n_model ||
          ' 件 / ブランドのみ ' || n_brand || ' 件 / 手がかりなし ' || n_loose || ' 件）' END AS basis_note
      FROM quotes"""
    sql["listing_exclusions"] = f"""WITH {LISTINGS},{OPTIONS},{TARGETS},{CLASSIFIED}
      SELECT quote_id, source, pos, price, exclude_reason IS NOT NULL AS excluded, exclude_reason FROM classified"""
    sql["match_tiers"] = f"""WITH {LISTINGS},{OPTIONS},{TARGETS},{CLASSIFIED}
      SELECT quote_id, source, pos, title, tier FROM classified"""
    sql["match_tiers_indexed"] = sql["match_tiers"]
    sql["quotes_selected"] = f"{QUOTED} SELECT * FROM quotes WHERE quote_id IN (1, 4, 1000000000)"
    least = BASE.replace(">= 3 THEN", ">= (quote_id % 4) * 10 THEN")
    sql["basis_choice_least"] = f"""{least} SELECT quote_id, basis_tier, n_model, n_brand, n_loose, n_basis, has_target,
      {TIER_LABEL.format('basis_tier')} AS label FROM basis"""
    sql["basis_choice"] = f"""{BASE} SELECT quote_id, basis_tier, n_model, n_brand, n_loose, n_basis, has_target,
      {TIER_LABEL.format('basis_tier')} AS label FROM basis"""
    sql["iqr_outliers"] = f"{BASE} SELECT quote_id, source, {ITEM_ID} AS item_id, price FROM final WHERE outlier"
    sql["iqr_bounds"] = f"""{BASE} SELECT quote_id, source, basis, CAST(floor(low * 100) AS BIGINT) AS low_sen,
      CAST(floor(high * 100) AS BIGINT) AS high_sen FROM fences"""
    sql["source_stats"] = f"{BASE},{SOURCE_STATS} SELECT * FROM source_stats"
    sql["pooled_stats"] = f"{BASE} SELECT quote_id, {_stats()} FROM final GROUP BY 1"
    sql["price_histogram"] = f"{BASE},{_histogram(SUGGESTED)} SELECT * FROM hist"
    sql["source_stats_wide"], sql["price_histogram_wide"] = sql["source_stats"], sql["price_histogram"]
    sql["quotes_wide"] = sql["quotes_incremental"] = sql["quote_headline"]
    sql["price_histogram_12"] = f"""{BASE},{_histogram('12')}
      SELECT quote_id, bin, lo, hi, CAST(coalesce(sum(n) FILTER (source = 'auction'), 0) AS BIGINT) AS n_auction,
        CAST(coalesce(sum(n) FILTER (source = 'market'), 0) AS BIGINT) AS n_market
      FROM hist GROUP BY 1, 2, 3, 4"""
    sql["quote_warnings"] = f"""{QUOTED},
      thin AS (SELECT quote_id, string_agg({LABEL.format('source')}, ' / ' ORDER BY source) AS names
               FROM source_stats WHERE count BETWEEN 1 AND 4 GROUP BY 1),
      used AS (SELECT quote_id, count(*) FILTER (count > 0) AS used, sum(count) AS total FROM source_stats GROUP BY 1)
      SELECT q.quote_id, concat_ws('|',
        CASE WHEN has_target AND basis_tier = 'all' THEN '{dims.NO_MATCH_WARNING}'
             WHEN basis_tier = 'brand' AND n_model > 0 THEN '品番が一致したのは ' || n_model || ' 件だけなので、ブランド一致まで広げて計算しています。' END,
        '{dims.THIN_WARNING}' || names,
        CASE WHEN total = 0 THEN '{dims.EMPTY_WARNING}' WHEN used = 1 THEN '{dims.ONE_SOURCE_WARNING}' END) AS warnings
      FROM quotes q LEFT JOIN thin USING (quote_id) JOIN used USING (quote_id)"""
    sql["verdicts"] = f"""{JUDGE} SELECT tag_id, quote_id, shop_price, condition, ok,
        CASE WHEN shop_price <= 0 THEN '{dims.NO_SHOP_PRICE}'
             WHEN NOT ok THEN '相場を出すには実売データが 3 件以上必要です（いま ' || n || ' 件）。' END AS reason,
        CASE WHEN ok THEN target0 END AS target, CASE WHEN ok THEN median0 END AS median,
        CASE WHEN ok THEN coalesce(floor(r * 100 + 0.5) / 100, 0) END AS ratio,
        CASE WHEN ok THEN band END AS verdict,
        CASE WHEN ok THEN CASE band WHEN 'bargain' THEN '安い' WHEN 'cheap' THEN 'やや安い' WHEN 'fair' THEN '相場どおり'
          WHEN 'pricey' THEN 'やや高い' ELSE '高い' END END AS verdict_label,
        CASE WHEN ok THEN tone_band END AS tone,
        CASE WHEN ok THEN CAST(floor(cheaper / CAST(n AS DOUBLE) * 100 + 0.5) AS BIGINT) END AS position_pct,
        CASE WHEN ok THEN n END AS count FROM sure"""
    sql["confidence"] = f"""{JUDGE} SELECT tag_id, CASE WHEN ok THEN level0 END AS level,
        CASE WHEN ok THEN {LEVEL_LABEL} END AS label, CASE WHEN ok THEN score0 END AS score,
        CASE WHEN ok THEN floor(spread0 * 100 + 0.5) / 100 END AS spread,
        CASE WHEN ok THEN concat_ws('|', CASE basis_tier WHEN 'model' THEN 'good:' ELSE 'warning:' END || why_tier,
          tone_n || ':' || why_n, tone_spread || ':' || why_spread) END AS reasons FROM sure"""
    condition = ("CASE condition WHEN 'new' THEN '新品・タグ付き' WHEN 'mint' THEN '美品' "
                 "WHEN 'worn' THEN '難あり・傷汚れ' ELSE '並・使用感あり' END")
    sql["verdict_factors"] = f"""{JUDGE},
      factors AS (
        SELECT tag_id, 0 AS place, 'ratio' AS key, '相場との差' AS label,
          coalesce(CAST(floor(r * 100 + 0.5) AS BIGINT), 0) || '%' AS value,
          {condition} || 'なら ' || {_yen('target0')} || ' あたり。値札は ' || {_yen('shop_price')} AS note, tone_band AS tone
        FROM sure WHERE ok
        UNION ALL
        SELECT tag_id, 1, 'position', '分布の位置', '下から ' || CAST(floor(cheaper / CAST(n AS DOUBLE) * 100 + 0.5) AS BIGINT) || '%',
          '集めた ' || n || ' 件のうち ' || cheaper || ' 件がこれより安い', 'neutral' FROM sure WHERE ok
        UNION ALL
        SELECT tag_id, 2, 'basis', '何と比べたか',
          CASE basis_tier WHEN 'model' THEN '品番一致' WHEN 'brand' THEN 'ブランド一致' ELSE '全件' END, why_tier,
          CASE basis_tier WHEN 'model' THEN 'good' ELSE 'warning' END FROM sure WHERE ok
        UNION ALL
        SELECT tag_id, 3, 'confidence', '相場の当てになり具合', {LEVEL_LABEL}, concat_ws(' / ', why_n, why_spread),
          CASE level0 WHEN 'high' THEN 'good' WHEN 'low' THEN 'warning' ELSE 'neutral' END FROM sure WHERE ok
      ) SELECT *, '{"|".join(dims.OFF_BOOK)}' AS off_book FROM factors"""
    status = ("CASE WHEN exclude_reason IS NOT NULL THEN exclude_reason WHEN outlier THEN '外れ値(IQR)' "
              "WHEN kept THEN '使用' ELSE '相場の対象外' END")
    sql["result_rows"] = f"""{BASE} SELECT quote_id, {LABEL.format('source')} AS label, {ITEM_ID} AS item_id, title, price,
      exclude_reason IS NOT NULL OR outlier AS excluded, {TIER_LABEL.format('tier')} AS tier_label, kept AS in_basis,
      {status} AS status FROM final"""
    sql["result_rows_top500"] = f"""{BASE} SELECT quote_id, place, item_id, price FROM (
        SELECT quote_id, {ITEM_ID} AS item_id, price, CAST(row_number() OVER (PARTITION BY quote_id
          ORDER BY price DESC, source, pos) AS INTEGER) AS place FROM final) x WHERE place <= 500"""
    by_key = " UNION ALL ".join(
        f"""SELECT '{key}' AS sorted_by, quote_id, CAST(row_number() OVER (PARTITION BY quote_id
          ORDER BY {order}, source, pos) AS INTEGER) AS place, {ITEM_ID} AS item_id FROM final WHERE kept"""
        for key, order in (("title", "title"), ("label", f"{LABEL.format('source')} DESC"), ("tier", "tier")))
    sql["result_rows_sorted"] = f"{BASE} SELECT * FROM ({by_key}) x WHERE place <= 500"
    sql["paste_item_ids"] = f"{PAGED} SELECT quote_id, {ITEM_ID} AS item_id, title, price FROM fx_listings"
    sql["quotes_mixed_inputs"] = f"""{MIXED} SELECT i.quote_id, coalesce(basis_tier, 'all') AS basis_tier,
      coalesce(n_basis, 0) AS n_basis, equal_weight_median, coalesce(combined_count, 0) AS combined_count,
      coalesce(sources_used, '') AS sources_used FROM ids i LEFT JOIN quotes q USING (quote_id)"""
    sql["mixed_cards"] = f"""{MIXED} SELECT quote_id, source, median, coalesce(count, 0) AS used,
      coalesce(n_read, 0) AS "read", coalesce(excluded_count - outlier_count, 0) AS excluded,
      coalesce(outlier_count, 0) AS outliers, CAST(0 AS BIGINT) AS untitled, error
      FROM inputs LEFT JOIN source_stats USING (quote_id, source)"""
    sql["mixed_warnings"] = f"""{MIXED},
      thin AS (SELECT quote_id, string_agg({LABEL.format('source')}, ' / ' ORDER BY source) AS names
               FROM source_stats WHERE count BETWEEN 1 AND 4 GROUP BY 1),
      used AS (SELECT quote_id, count(*) FILTER (count > 0) AS used, sum(count) AS total FROM source_stats GROUP BY 1),
      failed AS (SELECT quote_id, {LABEL.format('source')} || ': ' || error AS text FROM inputs WHERE error IS NOT NULL)
      SELECT i.quote_id, concat_ws('|', f.text,
        CASE WHEN coalesce(t.has_target, false) AND coalesce(basis_tier, 'all') = 'all' THEN '{dims.NO_MATCH_WARNING}'
             WHEN basis_tier = 'brand' AND n_model > 0 THEN '品番が一致したのは ' || n_model || ' 件だけなので、ブランド一致まで広げて計算しています。' END,
        '{dims.THIN_WARNING}' || names,
        CASE WHEN coalesce(total, 0) = 0 AND f.text IS NULL THEN '{dims.EMPTY_WARNING}'
             WHEN used = 1 THEN '{dims.ONE_SOURCE_WARNING}' END) AS warnings
      FROM ids i LEFT JOIN quotes q USING (quote_id) LEFT JOIN thin USING (quote_id) LEFT JOIN used USING (quote_id)
        LEFT JOIN failed f USING (quote_id) LEFT JOIN terms t USING (quote_id)"""
    sql["source_cards"] = f"""{BASE},{SOURCE_STATS} SELECT quote_id, source, {LABEL.format('source')} AS label, median, mean,
      p25, p75, count AS used, n_read AS "read", excluded_count - outlier_count AS excluded, outlier_count AS outliers,
      CAST(0 AS BIGINT) AS untitled FROM source_stats"""
    rules_on = " || ".join(
        f"CASE WHEN defaults_on AND NOT {_rule(i, 'query')} THEN '1' ELSE '0' END"
        for i in range(len(dims.EXCLUSION_RULES)))
    sql["option_defaults"] = f"""WITH {OPTIONS} SELECT quote_id, query, CAST(price_min AS BIGINT) AS price_min,
      CAST(price_max AS BIGINT) AS price_max, {rules_on} AS rules_on,
      CASE WHEN has_words THEN 'HOT|old' ELSE '' END AS exclude_words, remove_outliers, CAST(1.5 AS DOUBLE) AS iqr_k
      FROM fx_options"""
    sql["option_rejects"] = f"""SELECT c_custkey AS quote_id, '{dims.BOUNDS_REJECTED}' AS reason FROM customer
      WHERE c_custkey % 3 > 0 AND floor(c_acctbal) > 4000"""
    sql["brand_spellings"] = f"""WITH {TAGS},
      makers AS (SELECT tag_id, string_split(text, chr(10))[1] AS brand FROM tags),
      hit AS (SELECT m.tag_id, any_value(a.canonical) AS canonical FROM makers m JOIN aliases a ON a.folded = upper(m.brand) GROUP BY 1),
      spelled(canonical, aliases) AS (VALUES {", ".join("('{}', '{}')".format(n, "|".join([n, *o]).replace("'", "''")) for n, o in dims.BRANDS)})
      SELECT tag_id, brand, coalesce(aliases, brand) AS aliases
      FROM makers LEFT JOIN hit USING (tag_id) LEFT JOIN spelled USING (canonical)"""
    for form in ("auction", "market", "inline", "csv", "tsv", "bare"):
        sql[f"paste_roundtrip_{form}"] = _roundtrip(form)
    sql["parse_report"] = f"""{PAGED} SELECT quote_id, source, pos // 20 AS page, 'flow' AS mode,
      CAST(count(*) * 4 AS INTEGER) AS lines, CAST(count(*) AS INTEGER) AS prices_found, 0 AS untitled,
      CASE count(*) WHEN 1 THEN '送料込み|SOLD' WHEN 2 THEN '送料込み|SOLD|送料込み|SOLD'
        ELSE '送料込み|SOLD|送料込み|SOLD|送料込み' END AS ignored_samples, CAST(NULL AS VARCHAR) AS error
      FROM fx_listings GROUP BY 1, 2, 3"""
    lone = "count(*) = 1 AND min(price) < 300"
    sql["parse_report_tsv"] = f"""{PAGED} SELECT quote_id, source, pos // 20 AS page,
      CASE WHEN count(*) > 1 THEN 'table' ELSE 'flow' END AS mode, CAST(count(*) AS INTEGER) AS lines,
      CAST(CASE WHEN {lone} THEN 0 ELSE count(*) END AS INTEGER) AS prices_found, 0 AS untitled,
      '' AS ignored_samples, CASE WHEN {lone} THEN '{dims.UNREADABLE_PASTE}' END AS error
      FROM fx_listings GROUP BY 1, 2, 3"""
    sql["quotes_from_pastes"] = f"{QUOTED} SELECT quote_id, basis_tier, equal_weight_median, combined_count FROM quotes"
    sql["tag_identify"] = f"""WITH {TAGS} SELECT tag_id, brand, matched, 'JAPAN' AS made_in, model AS model_numbers,
      size AS sizes, material AS materials, array_to_string(keywords[1:6], '|') AS keywords FROM keyworded"""
    sql["tag_brands_indexed"] = f"""WITH {TAGS},
      spelled AS (SELECT canonical, alias, folded, ord FROM aliases UNION ALL
        SELECT p_brand, 'nd' || lpad(CAST(p_partkey AS STRING), 5, '0'), 'ND' || lpad(CAST(p_partkey AS STRING), 5, '0'),
          p_partkey + 1000 FROM part WHERE p_partkey % 7 = 3),
      best AS (SELECT x.tag_id, min((-length(y.folded), y.ord, y.canonical, y.alias)) AS b
               FROM folded x JOIN spelled y ON contains(x.folded, y.folded) GROUP BY 1)
      SELECT tag_id, b[3] AS brand, b[4] AS matched FROM folded LEFT JOIN best USING (tag_id)"""
    sql["tag_models_bare"] = """SELECT p_partkey AS tag_id, CAST(10000 + p_partkey AS STRING) AS model_numbers,
      CASE WHEN p_partkey % 2 = 0 THEN '160' ELSE '' END AS sizes,
      CASE WHEN p_partkey % 7 <> 0 THEN ['日本製', '中国製', 'ベトナム製', 'イタリア製', 'アメリカ製', '米国製'][p_partkey % 6 + 1] END AS made_in
      FROM part"""
    sql["tag_responses_empty"] = f"""SELECT p_partkey AS tag_id, CASE WHEN p_partkey % 3 = 2 THEN 'text_only' ELSE 'empty' END AS status,
      CASE WHEN p_partkey % 3 <> 2 THEN '{dims.EMPTY_RESPONSE}' END AS error,
      CASE WHEN p_partkey % 3 = 2 THEN p_name END AS text FROM part"""
    sql["tag_identify_hinted"] = f"""WITH {TAGS},{RESPONSES} SELECT r.tag_id, coalesce(h.brand, r.brand) AS brand,
      coalesce(h.made_in, 'JAPAN') AS made_in, coalesce(nullif(h.model_numbers, ''), r.model) AS model_numbers,
      coalesce(nullif(h.sizes, ''), r.size) AS sizes, coalesce(nullif(h.materials, ''), r.material) AS materials
      FROM read r LEFT JOIN hints h USING (tag_id)"""
    sql["search_queries"] = _queries_sql("SELECT * FROM ranked")
    sql["search_queries_noted"] = _queries_sql("SELECT * FROM ranked", noted=True)
    encoded = "url_encode(query)"
    for code, letter in {"%21": "!", "%27": "''", "%28": "(", "%29": ")"}.items():
        encoded = f"replace({encoded}, '{code}', '{letter}')"
    sources = " UNION ALL ".join(
        f"SELECT tag_id, rank, '{key}' AS source, replace('{url}', '{{}}', {encoded}) AS url FROM ranked"
        for key, _, url in dims.SOURCES)
    sql["search_urls"] = _queries_sql(sources)
    sql["ocr_clean_docs"] = _clean_docs("true")
    sql["ocr_confident_lines"] = _clean_docs(SURE_LINE)
    picks = """passes AS (
        SELECT CAST(floor(event_id / 11.0) AS BIGINT) AS photo_id, event_id % 11 AS ord, (event_id % 4) * 90 AS degrees,
          CAST(floor(value) AS BIGINT) % 100 AS confidence FROM events),
      probes AS (SELECT photo_id, degrees, row_number() OVER (PARTITION BY photo_id ORDER BY confidence DESC, ord) AS k
                 FROM passes WHERE ord < 8),
      tried AS (SELECT *, max(confidence) OVER (PARTITION BY photo_id ORDER BY ord
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM passes WHERE ord >= 8),
      kept AS (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY confidence DESC, ord) AS k
               FROM tried WHERE best_before IS NULL OR best_before < 85)"""
    picked = """SELECT p.photo_id, coalesce(b.degrees, 0) AS degrees, k.ord, k.confidence, k.confidence < 70 AS shaky
      FROM (SELECT DISTINCT photo_id FROM passes) p
      LEFT JOIN (SELECT * FROM probes WHERE k = 1) b USING (photo_id)
      LEFT JOIN (SELECT * FROM kept WHERE k = 1) k USING (photo_id)"""
    sql["ocr_pass_pick"] = f"WITH {picks} {picked}"
    sql["photo_texts"] = f"""WITH {picks}, picked AS ({picked}), cleaned AS ({_clean_docs(SURE_LINE)})
      SELECT p.*, coalesce(c.clean_text, '') AS clean_text FROM picked p
      LEFT JOIN cleaned c ON c.doc_id = (p.photo_id * 11 + p.ord) % (SELECT count(*) FROM documents)"""
    sql["tag_responses"] = f"""WITH {RESPONSES} SELECT tag_id, status, error, text, brand, made_in, model_numbers, sizes,
      materials FROM hints"""
    countries = " ".join(f"WHEN regexp_matches(digits, '{p}') THEN '{n}'" for p, n in dims.COUNTRY_PREFIXES)
    sql["barcode_check"] = f"""WITH codes AS (
        SELECT o_orderkey AS scan_id, CASE o_orderkey % 4 WHEN 0 THEN CAST(4900000000000 + o_orderkey AS STRING)
          WHEN 1 THEN lpad(CAST(o_custkey % 100 AS STRING), 2, '0') || lpad(CAST(o_orderkey AS STRING), 11, '0')
          WHEN 2 THEN '96-' || lpad(CAST(o_orderkey AS STRING), 6, '0')
          ELSE lpad(CAST(o_orderkey AS STRING), 12, '0') END AS code FROM orders),
      digits AS (SELECT scan_id, regexp_replace(code, '[^0-9]', '', 'g') AS digits FROM codes),
      summed AS (SELECT *, length(digits) AS size,
        list_sum(list_transform(string_split(reverse(digits[1:-2]), ''), lambda d, i: CAST(d AS INTEGER) * CASE WHEN i % 2 = 1 THEN 3 ELSE 1 END)) AS total
        FROM digits)
      SELECT scan_id, digits, size IN (8, 12, 13) AND (10 - total % 10) % 10 = CAST(right(digits, 1) AS INTEGER) AS valid,
        CASE size WHEN 13 THEN 'JAN/EAN-13' WHEN 8 THEN 'EAN-8' WHEN 12 THEN 'UPC-A' ELSE size || '桁のコード' END AS kind,
        CASE WHEN size = 13 THEN CASE {countries} END END AS country,
        CASE WHEN size = 13 AND regexp_matches(digits, '^4[59]') THEN left(digits, 7) END AS maker_code
      FROM summed"""
    sql["records_latest"] = f"{QUOTED},{RECORDS} SELECT * FROM saved ORDER BY created DESC LIMIT {dims.RECORDS_LISTED}"
    sql["records_delete"] = f"{QUOTED},{RECORDS} SELECT * FROM saved WHERE tier <> 'all'"
    sql["records_replay"] = f"""{REPLAYED},{SOURCE_STATS},{QUOTES}
      SELECT quote_id, basis_tier, n_model, equal_weight_median, combined_count, combined_median FROM
        (SELECT CAST(quote_id AS VARCHAR) AS quote_id, * EXCLUDE (quote_id) FROM quotes) q"""

    def cell(value: str) -> str:
        return f"""'"' || replace({value}, '"', '""') || '"'"""

    cells = [LABEL.format("source"), "title", "CAST(price AS VARCHAR)", TIER_LABEL.format("tier"),
             "CASE WHEN kept THEN 'yes' ELSE 'no' END",
             "CASE WHEN outlier THEN '外れ値(IQR)' ELSE coalesce(exclude_reason, '') END"]
    line = " || ',' || ".join(cell(c) for c in cells)
    sql["csv_export_lines"] = f"{BASE} SELECT quote_id, source, pos, {line} AS line FROM final"
    sql["title_keys"] = """SELECT p_partkey, 'title ・' || p_brand || '/' || p_name || '-(' || p_type || ')' AS normal,
      'TITLE ' || upper(p_brand) || ' ' || upper(p_name) || '- ' || upper(p_type) AS folded,
      'TITLE' || replace(upper(p_brand || p_name || p_type), ' ', '') AS compact FROM part"""
    return sql
