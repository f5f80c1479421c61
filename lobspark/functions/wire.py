"""The wire format: 23 message types, their fields, and Column expressions that decode and encode them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the exchange's published format: type, name, size, then "offset field width kind" after the
# common header (kind u: unsigned big-endian integer, c: text padded with spaces on the right).
HEADER = (("locate", 1, 2, "u"), ("tracking", 3, 2, "u"), ("ts_ns", 5, 6, "u"))
_SPEC = """
S|system event|12|11 event_code 1 c
R|stock directory|39|11 stock 8 c;19 market_category 1 c;20 financial_status 1 c;21 round_lot_size 4 u;25 round_lots_only 1 c;26 issue_classification 1 c;27 issue_subtype 2 c;29 authenticity 1 c;30 short_sale_threshold 1 c;31 ipo_flag 1 c;32 luld_tier 1 c;33 etp_flag 1 c;34 etp_leverage_factor 4 u;38 inverse_indicator 1 c
H|trading action|25|11 stock 8 c;19 trading_state 1 c;21 reason 4 c
Y|reg sho|20|11 stock 8 c;19 action 1 c
L|mp position|26|11 mpid 4 c;15 stock 8 c;23 primary_market_maker 1 c;24 market_maker_mode 1 c;25 participant_state 1 c
V|mwcb level|35|11 level1 8 u;19 level2 8 u;27 level3 8 u
W|mwcb status|12|11 breached_level 1 c
K|ipo quoting|28|11 stock 8 c;19 release_time 4 u;23 release_qualifier 1 c;24 ipo_price 4 u
J|luld collar|35|11 stock 8 c;19 reference_price 4 u;23 upper_price 4 u;27 lower_price 4 u;31 extension 4 u
h|operational halt|21|11 stock 8 c;19 market_code 1 c;20 halt_action 1 c
A|add|36|11 ref 8 u;19 side 1 c;20 shares 4 u;24 stock 8 c;32 price 4 u
F|add mpid|40|11 ref 8 u;19 side 1 c;20 shares 4 u;24 stock 8 c;32 price 4 u;36 attribution 4 c
E|executed|31|11 ref 8 u;19 shares 4 u;23 match 8 u
C|executed price|36|11 ref 8 u;19 shares 4 u;23 match 8 u;31 printable 1 c;32 price 4 u
X|cancel|23|11 ref 8 u;19 shares 4 u
D|delete|19|11 ref 8 u
U|replace|35|11 ref 8 u;19 new_ref 8 u;27 shares 4 u;31 price 4 u
P|trade|44|11 ref 8 u;19 side 1 c;20 shares 4 u;24 stock 8 c;32 price 4 u;36 match 8 u
Q|cross trade|40|11 shares 8 u;19 stock 8 c;27 price 4 u;31 match 8 u;39 cross_type 1 c
B|broken trade|19|11 match 8 u
I|noii|50|11 paired_shares 8 u;19 imbalance_shares 8 u;27 imbalance_direction 1 c;28 stock 8 c;36 far_price 4 u;40 near_price 4 u;44 reference_price 4 u;48 cross_type 1 c;49 price_variation 1 c
N|rpii|20|11 stock 8 c;19 interest_flag 1 c
O|dlcr|48|11 stock 8 c;19 open_eligibility 1 c;20 min_price 4 u;24 max_price 4 u;28 near_execution_price 4 u;32 near_execution_time 8 u;40 lower_collar 4 u;44 upper_collar 4 u
"""


# Fixed values that a directory entry is written with where none are given; all other fields default to zeros or spaces.
DEFAULTS = {
    "R": {
        "market_category": "Q", "financial_status": "N", "round_lot_size": 100, "round_lots_only": "N", "issue_classification": "C",
        "issue_subtype": "Z ", "authenticity": "P", "short_sale_threshold": "N", "ipo_flag": "N", "luld_tier": "1",
        "etp_flag": "N", "etp_leverage_factor": 0, "inverse_indicator": "N",
    },
}


def _field(text: str) -> tuple[str, int, int, str]:
    at, name, width, kind = text.split()
    return name, int(at), int(width), kind


_LINES = [line.split("|") for line in _SPEC.strip().splitlines()]
NAMES = {t: name for t, name, _, _ in _LINES}
SIZES = {t: int(size) for t, _, size, _ in _LINES}
FIELDS = {t: HEADER + tuple(map(_field, fields.split(";"))) for t, _, _, fields in _LINES}
BOOK = ("A", "F", "E", "C", "X", "D", "U")


def lookup(key: Column, table: dict, missing) -> Column:
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.create_map(*pairs)[key], F.lit(missing))


def spec_size(kind: Column) -> Column:
    """Size of a type's messages, 0 for unknown types."""
    return lookup(kind, SIZES, 0)


def message_name(kind: Column) -> Column:
    return lookup(kind, NAMES, "unknown")


def is_book_event(kind: Column) -> Column:
    return kind.isin(*BOOK)


def unsigned(payload: Column, at: int, width: int) -> Column:
    """Big-endian unsigned integer as decimal(20,0)."""
    return F.conv(F.hex(F.substring(payload, at + 1, width)), 16, 10).cast("decimal(20,0)")


def decode(payload: Column, kind: str) -> list[Column]:
    """All fields of one type. 64-bit fields are decimal(20,0), smaller ones bigint; text keeps its padding."""
    out = []
    for name, at, width, what in FIELDS[kind]:
        if what == "c":
            value = F.decode(F.substring(payload, at + 1, width), "US-ASCII")
        else:
            value = unsigned(payload, at, width)
            value = value if width == 8 else value.cast("long")
        out.append(value.alias(name))
    return out


def number(value: Column, width: int) -> Column:
    digits = F.conv(value.cast("decimal(20,0)").cast("string"), 10, 16)
    return F.unhex(F.lpad(digits, 2 * width, "0"))


def encode(kind: str, values: dict[str, Column]) -> Column:
    """The payload of one type; fields without a value take DEFAULTS, else zeros or spaces. Text is cut or padded to its width."""
    values = {k: F.lit(v) for k, v in DEFAULTS.get(kind, {}).items()} | values
    parts, at = [F.encode(F.lit(kind), "US-ASCII")], 1
    for name, start, width, what in FIELDS[kind]:
        if start > at:
            parts.append(F.encode(F.lit(" " * (start - at)), "US-ASCII"))
        if what == "c":
            parts.append(F.encode(F.rpad(values.get(name, F.lit("")), width, " "), "US-ASCII"))
        else:
            parts.append(number(values.get(name, F.lit(0)), width))
        at = start + width
    return F.concat(*parts)


def framed(payload: Column) -> Column:
    """Two-byte big-endian length, then the payload."""
    return F.concat(number(F.length(payload), 2), payload)
