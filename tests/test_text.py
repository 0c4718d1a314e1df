from pricetide import dims
from pricetide.functions import money
from pricetide.functions import text as tx
from pricetide.sources import dictionary


def test_nfkc_and_squeeze(column_values):
    got = column_values(lambda v: tx.squeeze(tx.nfkc(v)), ["Ｌサイズ　　ダウン", None, "a\t b\n", "ｶﾞ ㌢ ①"])
    assert got == ["Lサイズ ダウン", "", "a b", "ガ センチ 1"]


def test_fold_and_compact(column_values):
    words = ["The North・Face／ヌプシ", "ND-91841 k", "Arc'teryx", "  ", "L.L.Bean #1 100%"]
    assert column_values(tx.fold, words) == ["THE NORTH FACE ヌプシ", "ND-91841 K", "ARC TERYX", "", "L.L.BEAN #1 100%"]
    assert column_values(lambda v: tx.compact(tx.fold(v)), words)[:2] == ["THENORTHFACEヌプシ", "ND91841K"]


def test_folded_literals_agree_with_columns(column_values):
    aliases = [alias for _, alias in dictionary.ordered_aliases()]
    assert column_values(tx.fold, aliases) == [tx.fold_literal(a) for a in aliases]


def test_no_spelling_twice():
    spellings = [s.upper() for name, others in dims.BRANDS for s in [name, *others]]
    assert len(set(spellings)) == len(spellings)


def test_nice_steps(column_values):
    raw = [1.0, 3.0, 237.0, 1001.0, 0.0, 2.2, 10.0]
    assert column_values(money.nice_step, raw, "double") == [1, 5, 250, 2000, 1, 3, 10]


def test_rounding_goes_up_at_half(column_values):
    assert column_values(money.round_half_up, [2.5, -2.5, 17.49], "double") == [3, -2, 17]


def test_money_words(column_values):
    assert column_values(money.yen, [1234567.0, 12.5, 300.0], "double") == ["¥1,234,567", "¥12.5", "¥300"]
