"""Public column expressions. All of them are built-in Spark expressions: no Python runs per row."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import BROKERS, INCOME_KINDS, MONTHS, WASTE_STATUS, legacy_by_key
from .money import col, euros, half_up, idiv

# Payee noise words, subscription periods, plan rhythm, shelf life once opened.
NOISE_WORDS = (
    "gmbh", "ag", "se", "kg", "ug", "ltd", "limited", "inc", "llc", "sarl", "bv", "co", "ohg", "ev", "sa",
    "paypal", "europe", "international", "com", "www", "de", "eu",
)
MONTHS_PER_PERIOD = {"monthly": 1, "quarterly": 3, "yearly": 12}
TWELFTHS_PER_MONTH = {"weekly": 52, "biweekly": 26, "monthly": 12}
DAYS_ONCE_OPENED = {"fridge": 4, "pantry": 14, "freezer": 30}
# Codes that bookings name, sentences that questions and lists are made of.
WKN = r"WPKNR:\s*([A-Z0-9]{6})"
ISIN = r"\b([A-Z]{2}[A-Z0-9]{9}\d)\b"
BOOKING_LINE = "#{id} | {day}{bought} | {amount} | {payee} | {kind}{ref}"
BOUGHT, REF, WHY = " (bought {day})", " | ref {ref}", " Why unsure: {reason}"
RECEIPT_QUESTION = "Is the {amount} EUR payment to {payee} booked on {day}{bought} the {store} receipt from {receipt_day} ({total} EUR)?{why}"
TRANSFER_QUESTION = (
    "Is the {amount} EUR leaving {bank} on {day} the same money as the {other_amount} EUR arriving on {other_bank} on {other_day} "
    "(a transfer between your own accounts)?{why}"
)
MIRROR_QUESTION = (
    "Is the {amount} EUR PayPal payment to {payee} on {day} the same payment as the {other_bank} booking of {other_amount} EUR on {other_day} ({other_payee})?{why}"
)
QUESTION_LENGTH = 600
# End of the fixed values.


def sentence(template: str, **parts: Column) -> Column:
    """A template filled in; null if a part is."""
    pieces = []
    for text, name, _, _ in Formatter().parse(template):
        pieces += [F.lit(text)] if text else []
        pieces += [parts[name].cast("string")] if name else []
    return F.concat(*pieces)


def literal_map(value, mapping: dict, default=None) -> Column:
    """A small fixed lookup as CASE WHEN."""
    value = col(value)
    start = F
    for key, result in mapping.items():
        start = start.when(value == F.lit(key), F.lit(result))
    return start.otherwise(default if isinstance(default, Column) else F.lit(default))


# ---- names ---------------------------------------------------------------------------------------------
def payee_key(name) -> Column:
    """One key per payee: legal forms, noise words and bare numbers are dropped."""
    lowered = F.lower(col(name))
    joined = F.regexp_replace(lowered, r"\b([a-z])\.([a-z])\.", "$1$2")
    plain = F.regexp_replace(joined, r"[^a-z0-9]+", " ")
    words = F.filter(
        F.split(plain, " "),
        lambda w: (w != "") & ~w.isin(*NOISE_WORDS) & ~w.rlike("^[0-9]+$"),
    )
    kept = F.array_join(words, " ")
    rest = F.trim(plain)
    return F.when(kept != "", kept).when(rest != "", rest).otherwise(F.lit("unknown"))


def slug(key) -> Column:
    return F.regexp_replace(col(key), " ", "-")


def slugify(label) -> Column:
    text = F.regexp_replace(F.regexp_replace(F.lower(col(label)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(text == "", F.lit("category")).otherwise(text)


def product_key(name) -> Column:
    return F.regexp_replace(F.trim(F.lower(col(name))), r"\s+", " ")


def product_title(name) -> Column:
    """Trimmed, every run of letters capitalised ('rye bread 1.5l' -> 'Rye Bread 1.5L')."""
    runs = F.regexp_extract_all(F.trim(col(name)), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    capital = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))
    return F.array_join(F.transform(runs, capital), "")


def trimmed_lower(name) -> Column:
    return F.lower(F.trim(col(name)))


def collapse_space(text) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"\s+", " "))


# ---- calendar ------------------------------------------------------------------------------------------
def month_index(date) -> Column:
    return (F.year(col(date)) * 12 + F.month(col(date)) - 1).cast("int")


def month_label(index) -> Column:
    """'Apr 26' of a month index."""
    names = F.array(*[F.lit(m) for m in MONTHS])
    year = F.lpad((F.floor(col(index) / 12) % 100).cast("string"), 2, "0")
    return F.concat(F.get(names, col(index) % 12), F.lit(" "), year)


def month_abbr(index) -> Column:
    return F.get(F.array(*[F.lit(m) for m in MONTHS]), col(index) % 12)


def month_number(abbr) -> Column:
    return literal_map(abbr, {m: i + 1 for i, m in enumerate(MONTHS)}).cast("int")


def month_shift(index, months: int) -> Column:
    return (col(index) + F.lit(months)).cast("int")


def month_start(index) -> Column:
    return F.make_date(F.floor(col(index) / 12).cast("int"), (col(index) % 12 + 1).cast("int"), F.lit(1))


def effective_date(purchase="purchase_date", booking="booking_date") -> Column:
    return F.coalesce(col(purchase), col(booking))


# ---- money ---------------------------------------------------------------------------------------------
def line_total(quantity="quantity", unit="unit_c", discount="discount_c") -> Column:
    return F.coalesce(col(quantity), F.lit(1)) * col(unit) - F.coalesce(col(discount), F.lit(0))


def _units(quantity) -> Column:
    return F.greatest(F.coalesce(col(quantity), F.lit(1)), F.lit(1))


def net_line_c(quantity="quantity", unit="unit_c", discount="discount_c") -> Column:
    """Net price of the whole line in cents, never negative."""
    return F.greatest(F.lit(0).cast("bigint"), col(unit) * _units(quantity) - F.coalesce(col(discount), F.lit(0)))


def net_unit_price(quantity="quantity", unit="unit_c", discount="discount_c") -> Column:
    """Net price of one piece, in euros."""
    return net_line_c(quantity, unit, discount) / _units(quantity) / F.lit(100.0)


def value_of(amount, quantity="quantity", unit="unit_c", discount="discount_c") -> Column:
    """Cents that `amount` pieces of a line are worth."""
    return F.round(col(amount) * net_line_c(quantity, unit, discount) / _units(quantity)).cast("bigint")


def monthly_cost_c(amount, frequency) -> Column:
    return half_up(col(amount), literal_map(frequency, MONTHS_PER_PERIOD, 1).cast("bigint"))


def per_month_c(amount, frequency) -> Column:
    return half_up(col(amount) * literal_map(frequency, TWELFTHS_PER_MONTH, 12), F.lit(12).cast("bigint"))


def twelfths_c(amount, frequency) -> Column:
    """Monthly amount times twelve: exact, so totals can be rounded once."""
    return col(amount) * literal_map(frequency, TWELFTHS_PER_MONTH, 12).cast("bigint")


def split_line(fixed_pct, has_spending) -> Column:
    rest = F.when(has_spending, F.lit(100) - fixed_pct).otherwise(F.lit(0))
    shown = F.when(has_spending, fixed_pct).otherwise(F.lit(0))
    return F.concat(shown.cast("string"), F.lit("% Fixed / "), rest.cast("string"), F.lit("% Variable"))


def signed_euros(c) -> Column:
    """'+12.30' / '-4.05' of cents."""
    c = col(c)
    return F.concat(F.when(c < 0, F.lit("-")).otherwise(F.lit("+")), plain_euros(F.abs(c)))


def plain_euros(c) -> Column:
    """'12.30' of cents ('-4.05' when negative)."""
    c = col(c)
    size = F.abs(c)
    return F.concat(
        F.when(c < 0, F.lit("-")).otherwise(F.lit("")),
        idiv(size, 100).cast("string"), F.lit("."), F.lpad((size % 100).cast("string"), 2, "0"),
    )


# ---- investments ---------------------------------------------------------------------------------------
def instrument_code(text) -> Column:
    """The WKN a booking names, else its ISIN, else null."""
    text = F.coalesce(col(text), F.lit(""))
    wkn = F.regexp_extract(text, WKN, 1)
    isin = F.regexp_extract(text, ISIN, 1)
    return F.coalesce(F.nullif(wkn, F.lit("")), F.nullif(isin, F.lit("")))


def booking_ref(bank, date, amount_c, description) -> Column:
    """A fingerprint of a booking that survives reading its statement again."""
    text = F.concat_ws("|", col(bank), col(date).cast("string"), plain_euros(amount_c), collapse_space(description))
    return F.substring(F.sha1(text), 1, 16)


def is_depot_row(bank, counterparty, description) -> Column:
    text = F.lower(F.concat_ws(" ", col(counterparty), col(description)))
    return F.when(col(bank) == "Commerzbank", True).when(col(bank) == "N26", text.contains("equities")).otherwise(False)


def broker_rank(bank) -> Column:
    return literal_map(bank, {b: i for i, b in enumerate(BROKERS)}, len(BROKERS))


def plan_status(day, start="start_date", end="end_date") -> Column:
    day = day if isinstance(day, Column) else F.lit(day)
    return (
        F.when(col(start) > day, F.lit("scheduled")).when(col(end) < day, F.lit("ended")).otherwise(F.lit("active"))
    )


# ---- stock ---------------------------------------------------------------------------------------------
def stock_group(storage, is_food) -> Column:
    return (
        F.when(col(storage) == "Frozen", F.lit("freezer"))
        .when(col(storage) == "Kept Cool", F.lit("fridge"))
        .when(is_food, F.lit("pantry"))
        .otherwise(F.lit("home"))
    )


def effective_expiry(group, expiry="date_expiry", opened="opened_on", days="days_once_opened") -> Column:
    """The best-before date, or sooner when the package was opened (never for things that are not food)."""
    default = literal_map(group, DAYS_ONCE_OPENED)
    life = F.coalesce(F.when(col(days) != 0, col(days)), default)
    limit = F.when(col(group) != "home", F.date_add(col(opened), life))
    return F.least(col(expiry), limit)


def urgency(days_left) -> Column:
    d = col(days_left)
    return (
        F.when(d.isNull(), F.lit("none")).when(d < 0, F.lit("expired")).when(d <= 3, F.lit("soon"))
        .when(d <= 7, F.lit("week")).otherwise(F.lit("ok"))
    )


def is_stale(days_left) -> Column:
    return F.coalesce(col(days_left) < -14, F.lit(False))


def waste_status(reason) -> Column:
    return literal_map(reason, WASTE_STATUS, "Discarded")


# ---- categories ----------------------------------------------------------------------------------------
def default_category(kind) -> Column:
    return literal_map(kind, {"fee": "bank_fees", "cash": "cash"})


def legacy_category(key) -> Column:
    """Coarse pantry category of a category key; own categories are 'Other'."""
    return F.coalesce(literal_map(key, legacy_by_key()), F.lit("Other"))


def entry_flow(kind, amount_c) -> Column:
    """Flow of a booking when a person picks its category."""
    income = col(kind).isin(*INCOME_KINDS) | (col(amount_c) > 0)
    return F.when(income, F.lit("income")).otherwise(F.lit("expense"))


def submitted_flow(kind, amount_c) -> Column:
    """Flow of a submitted statement line: the sign only decides for kind 'other'."""
    income = col(kind).isin(*INCOME_KINDS) | ((col(kind) == "other") & (col(amount_c) > 0))
    return F.when(income, F.lit("income")).otherwise(F.lit("expense"))


# ---- keys and display text -----------------------------------------------------------------------------
def merge_key(date, amount_c, counterparty, reference) -> list[Column]:
    """Identity of a listed payment, as columns m_date, m_amount, m_name, m_ref."""
    return [
        col(date).alias("m_date"), col(amount_c).alias("m_amount"),
        trimmed_lower(counterparty).alias("m_name"),
        F.trim(F.coalesce(col(reference), F.lit(""))).alias("m_ref"),
    ]


def link_key(date, amount_c, description) -> list[Column]:
    """Identity of a booking across imports, as columns k_date, k_amount, k_text."""
    return [col(date).alias("k_date"), col(amount_c).alias("k_amount"), col(description).alias("k_text")]


def _or_nothing(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def booking_line(prefix="") -> Column:
    own = lambda c: F.col(f"{prefix}{c}")
    return sentence(
        BOOKING_LINE, id=own("id"), day=own("booking_date"), bought=_or_nothing(sentence(BOUGHT, day=own("purchase_date"))), amount=signed_euros(f"{prefix}amount_c"),
        payee=own("counterparty"), kind=own("kind"), ref=_or_nothing(sentence(REF, ref=F.nullif(own("payment_reference"), F.lit("")))),
    )


def _question(template: str, reason, **parts: Column) -> Column:
    why = F.when(F.length(reason) > 0, sentence(WHY, reason=reason)).otherwise(F.lit(""))
    amount = plain_euros(F.abs(F.col("t_amount_c")))
    return F.substring(sentence(template, amount=amount, day=F.col("t_booking_date"), why=why, **parts), 1, QUESTION_LENGTH)


def receipt_question(reason) -> Column:
    """Needs columns t_* (booking) and r_* (receipt)."""
    return _question(
        RECEIPT_QUESTION, reason, payee=F.col("t_counterparty"), bought=_or_nothing(sentence(BOUGHT, day=F.col("t_purchase_date"))),
        store=F.col("r_store_name"), receipt_day=F.col("r_purchase_date"), total=plain_euros("r_total_c"),
    )


def transfer_question(reason) -> Column:
    """Needs columns t_* (outgoing side) and o_* (incoming side)."""
    return _question(
        TRANSFER_QUESTION, reason, bank=F.col("t_bank"), other_amount=plain_euros("o_amount_c"), other_bank=F.col("o_bank"), other_day=F.col("o_booking_date"),
    )


def mirror_question(reason) -> Column:
    """Needs columns t_* (payment list row) and o_* (bank booking)."""
    return _question(
        MIRROR_QUESTION, reason, payee=F.col("t_counterparty"), other_bank=F.col("o_bank"), other_amount=plain_euros(F.abs(F.col("o_amount_c"))),
        other_day=F.col("o_booking_date"), other_payee=F.col("o_counterparty"),
    )


__all__ = [name for name in dir() if not name.startswith("_")] + ["euros"]
