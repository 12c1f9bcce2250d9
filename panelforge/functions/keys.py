"""Column builders for keys and categories: stock codes, dates, boards, exchanges, index buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN_BOARD = "UNKNOWN_BOARD"
UNKNOWN_INDUSTRY = "unknown_industry"

# Board names, aliases and code prefixes of the market.
BOARDS = ("CHINEXT", "STAR", "BSE", "SSE_MAIN", "SZSE_MAIN")
MAIN_BOARDS = ("SSE_MAIN", "SZSE_MAIN")
BOARD_ALIASES = {
    "CHINEXT": "CHINEXT",
    "CHI_NEXT": "CHINEXT",
    "CHINEXT_BOARD": "CHINEXT",
    "创业板": "CHINEXT",
    "STAR": "STAR",
    "STAR_BOARD": "STAR",
    "科创板": "STAR",
    "BSE": "BSE",
    "BJSE": "BSE",
    "北交所": "BSE",
    "SSE_MAIN": "SSE_MAIN",
    "SSE_MAIN_BOARD": "SSE_MAIN",
    "SZSE_MAIN": "SZSE_MAIN",
    "SZSE_MAIN_BOARD": "SZSE_MAIN",
}
EXCHANGE_BOARDS = {
    ("SZSE", "创业板"): "CHINEXT",
    ("SSE", "科创板"): "STAR",
    ("BSE", "北交所"): "BSE",
    ("BJSE", "北交所"): "BSE",
    ("SSE", "主板"): "SSE_MAIN",
    ("SZSE", "主板"): "SZSE_MAIN",
    ("SZSE", "中小板"): "SZSE_MAIN",
}
BOARD_PREFIXES = {
    "STAR": ("688", "689"),
    "CHINEXT": ("300", "301", "302"),
    "BSE": ("920", "830", "831", "832", "833", "834", "835", "836", "837", "838", "839"),
    "SSE_MAIN": ("600", "601", "603", "605"),
    "SZSE_MAIN": ("000", "001", "002", "003"),
}
EXCHANGE_ALIASES = {"SH": "SSE", "SHSE": "SSE", "SZ": "SZSE", "BJ": "BSE", "BJSE": "BSE"}


def _text(value: Column) -> Column:
    return F.trim(F.coalesce(value.cast("string"), F.lit("")))


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def finite(value: Column) -> Column:
    """The number as double, or null if it is null, NaN or infinite. Text that is no number is null."""
    x = value.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def _padded(code: Column) -> Column:
    return F.when(code.rlike("^[0-9]{1,6}$"), F.lpad(code, 6, "0")).otherwise(code)


def stock_code(value: Column, suffix: str = "market") -> Column:
    """Codes as six digits.

    ``suffix`` says what may follow the digits: ``market`` drops ``.SZ`` and ``.0`` alike, ``any`` drops
    everything behind a dot, ``decimal`` drops only ``.0`` and ``none`` drops nothing. Null gives an
    empty string; ``any`` also maps the texts nan, none and nat to it.
    """
    text = _text(value)
    if suffix == "none":
        return F.when(F.length(text) < 6, F.lpad(text, 6, "0")).otherwise(text)
    if suffix == "decimal":
        return _padded(F.regexp_replace(text, r"^([0-9]+)\.0$", "$1"))
    if suffix == "any":
        bare = F.regexp_replace(text, r"^([0-9]+)\..*$", "$1")
        return F.when(F.lower(text).isin("nan", "none", "nat"), F.lit("")).otherwise(_padded(bare))
    if suffix == "market":
        return _padded(F.regexp_replace(text, r"^([0-9]+)\.([A-Za-z]+|[0-9]+)$", "$1"))
    raise ValueError(f"unknown suffix rule {suffix!r}")


def category(value: Column) -> Column:
    """Trimmed text, null if blank."""
    text = F.trim(value.cast("string"))
    return F.when(text != "", text)


def category_label(value: Column) -> Column:
    """Whole numbers print without decimals."""
    x = value.try_cast("double")
    whole = x.isNotNull() & (x == F.floor(x))
    return F.when(whole, x.cast("long").cast("string")).otherwise(value.cast("string"))


def parsed_date(value: Column) -> Column:
    """A date from a date, a timestamp or text in one of the usual forms; null if none fits."""
    text = F.trim(value.cast("string"))
    iso = F.regexp_extract(F.regexp_replace(text, "/", "-"), r"^([0-9]{4}-[0-9]{1,2}-[0-9]{1,2})", 1)
    return F.coalesce(F.try_to_date(F.when(text.rlike("^[0-9]{8}$"), text), "yyyyMMdd"), F.try_to_date(F.when(iso != "", iso), "yyyy-M-d"))


def symbol_of(code: Column) -> Column:
    """Six-digit code with the exchange its first digit implies; dotted codes stay, unknown ones are null."""
    first = F.substring(code, 1, 1)
    market = F.when(first == "6", "SH").when(first.isin("0", "2", "3"), "SZ").when(first.isin("8", "9"), "BJ")
    return F.when(F.instr(code, ".") > 0, code).otherwise(F.concat(code, F.lit("."), market))


def exchange_code(value: Column) -> Column:
    text = F.upper(_text(value))
    return F.coalesce(F.try_element_at(_map(EXCHANGE_ALIASES), text), text)


def board_code(value: Column) -> Column:
    """Board aliases to board codes; other text upper-cased with underscores; null gives an empty string."""
    text = _text(value)
    joined = F.regexp_replace(F.upper(text), r"[\s\-]+", "_")
    aliases = _map(BOARD_ALIASES)
    return F.coalesce(F.try_element_at(aliases, text), F.try_element_at(aliases, joined), joined)


def main_board(exchange: Column) -> Column:
    code = exchange_code(exchange)
    return F.when(code == "SSE", "SSE_MAIN").when(code == "SZSE", "SZSE_MAIN").otherwise("")


def reference_board(value: Column, exchange: Column) -> Column:
    """Canonical board code of a reference entry; main boards go by exchange; anything else is empty."""
    text, code = _text(value), board_code(value)
    main = (F.upper(text) == "MAIN") | (text == "主板")
    return F.when(main, main_board(exchange)).when(code.isin(*BOARDS, UNKNOWN_BOARD), code).otherwise("")


def board_segment(board: Column, exchange: Column) -> Column:
    """One of the five listing segments, or an empty string."""
    code = F.upper(_text(board))
    return F.when(code == "MAIN", main_board(exchange)).when(code.isin(*BOARDS), code).otherwise("")


def inferred_board(code: Column, market_type: Column, exchange: Column) -> Column:
    """struct(board, source): by exchange and market type, then market type alone, then code prefix."""
    market = _text(market_type)
    by_both = F.try_element_at(_map({f"{e}|{m}": b for (e, m), b in EXCHANGE_BOARDS.items()}), F.concat(exchange_code(exchange), F.lit("|"), market))
    alias = board_code(market_type)
    by_alias = F.when((alias != "") & (alias != UNKNOWN_BOARD), alias)
    by_prefix = F.coalesce(*[F.when(F.substring(code, 1, 3).isin(*p), b) for b, p in BOARD_PREFIXES.items()])
    board = F.coalesce(by_both, by_alias, by_prefix, F.lit(UNKNOWN_BOARD))
    source = F.when(by_both.isNotNull(), "exchange_market_mapping").when(by_alias.isNotNull(), "market_type_alias").when(by_prefix.isNotNull(), "prefix_fallback").otherwise("unknown")
    return F.struct(board.alias("board"), source.alias("source"))


# Index flags in order of precedence.
INDEX_FLAGS = {"is_csi300": "CSI300", "is_csi500": "CSI500", "is_csi1000": "CSI1000", "is_csi2000": "CSI2000"}


def index_bucket(missing: str | None = None) -> Column:
    """Name of the first index flag that is 1, else NON_INDEX; ``missing`` if any flag is null."""
    first = F.coalesce(*[F.when(F.col(c).cast("int") == 1, n) for c, n in INDEX_FLAGS.items()], F.lit("NON_INDEX"))
    known = F.lit(True)
    for c in INDEX_FLAGS:
        known = known & F.col(c).isNotNull()
    return F.when(known, first).otherwise(F.lit(missing))
