"""Ledger schemas, the ledger bundle and the fixed value lists.

Money is carried as whole cents (`*_c`, bigint): sums are exact, stay inside whole-stage codegen and never
need a wide decimal.  Result columns are euros (double).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame

KEYS = ("household_id",)

# DDL text: Spark readers and createDataFrame take it as it is.
SCHEMAS = {
    "statements": (
        "household_id bigint, id bigint, bank string, owner string, month_index int, opening_c bigint, "
        "closing_c bigint, has_balances boolean, period_start date, period_end date, file_hash string, "
        "status string, review_note string"
    ),
    "bookings": (
        "household_id bigint, id bigint, statement_id bigint, booking_date date, purchase_date date, "
        "amount_c bigint, counterparty string, description string, channel string, payment_reference string, "
        "kind string, category string, receipt_id bigint, link_status string, link_reason string, "
        "transfer_group bigint, mirror_of bigint"
    ),
    "receipts": (
        "household_id bigint, id bigint, store_name string, total_c bigint, discount_c bigint, "
        "purchase_date date, linked boolean, owner string, file_hash string, receipt_number string, "
        "payment_reference string, payment_method string, status string, review_note string"
    ),
    "items": (
        "household_id bigint, id bigint, receipt_id bigint, name string, brand string, quantity int, "
        "unit_c bigint, discount_c bigint, category string, storage_condition string, date_purchased date, "
        "date_expiry date, spend_category string, status string, quantity_left double, wasted_quantity double, "
        "wasted_on date, waste_reason string, opened_on date, days_once_opened int, finished_on date, "
        "location string, rating int, would_rebuy boolean"
    ),
    "categories": (
        "key string, label string, group_name string, flow string, fixed boolean, description string, "
        "sort_order int, active boolean"
    ),
    "questions": (
        "household_id bigint, id bigint, kind string, transaction_id bigint, receipt_id bigint, "
        "other_transaction_id bigint, question string, status string, created_at timestamp, answered_at timestamp"
    ),
    "rules": ("household_id bigint, key string, frequency string, hidden boolean"),
    "plans": (
        "household_id bigint, id bigint, broker string, instrument string, amount_c bigint, frequency string, "
        "anchor_date date, start_date date, end_date date, note string"
    ),
    "splits": ("household_id bigint, id bigint, booking_ref string, instrument string, amount_c bigint"),
}

STATEMENT_DOC = (
    "household_id bigint, doc_hash string, owner string, bank string, period_start date, period_end date, "
    "opening_balance decimal(14,2), closing_balance decimal(14,2), review_note string, "
    "transactions array<struct<booking_date: date, purchase_date: date, amount: decimal(14,2), "
    "counterparty: string, description: string, channel: string, payment_reference: string, kind: string, "
    "category: string>>"
)
RECEIPT_DOC = (
    "household_id bigint, doc_hash string, owner string, store_name string, purchase_date date, "
    "total_amount decimal(14,2), payment_method string, receipt_number string, payment_reference string, "
    "review_note string, items array<struct<name: string, quantity: int, unit_price: decimal(14,2), "
    "discount: decimal(14,2), spend_category: string, storage_condition: string, "
    "estimated_shelf_life_days: int, days_once_opened: int, brand: string>>"
)


@dataclass(frozen=True)
class Later:
    """A table that is made when it is first asked for."""

    make: Callable[[], DataFrame]


@dataclass(frozen=True)
class Ledger:
    """The ledger tables as DataFrames. `keys` are the tenant columns put in front of every key."""

    statements: DataFrame = None
    bookings: DataFrame = None
    receipts: DataFrame = None
    items: DataFrame = None
    categories: DataFrame = None
    questions: DataFrame = None
    rules: DataFrame = None
    plans: DataFrame = None
    splits: DataFrame = None
    keys: tuple = field(default=KEYS)

    def __getattribute__(self, name):
        value = object.__getattribute__(self, name)
        if isinstance(value, Later):
            value = value.make()
            object.__setattr__(self, name, value)
        return value

    def with_(self, **tables) -> "Ledger":
        """The ledger with other tables; those nobody has asked for yet stay unmade."""
        return Ledger(**({f.name: object.__getattribute__(self, f.name) for f in fields(self)} | tables))

    @property
    def spark(self):
        return self.categories.sparkSession

    def on(self, *columns: str) -> list[str]:
        return [*self.keys, *columns]

    def dim_on(self, dim: DataFrame, *columns: str) -> list[str]:
        """Join columns for a dimension that is either shared (no tenant columns) or per tenant."""
        return [k for k in self.keys if k in dim.columns] + list(columns)


# ---------------------------------------------------------------------------------------------------------
# They must equal the household app's own lists for the results to agree.
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
SPEND_KINDS = ("spend", "fee", "cash", "other")
NO_CATEGORY_KINDS = ("internal_transfer", "investment")
INCOME_KINDS = ("income", "refund")
BROKERS = ("N26", "Commerzbank", "Sparkasse")
ALWAYS_LISTED = ("N26", "Commerzbank")
PAYPAL = "PayPal"
UNKNOWN = "Unknown"
MANUAL = "Manual buys"
UNCATEGORIZED = "uncategorized"
UNCATEGORIZED_INCOME = "uncategorized_income"
INVESTMENTS_KEY = "investments"
NOT_STOCK = ("eating_out", "takeaway", "deposit")
BILL_CATEGORIES = ("rent", "loans", "insurance", "utilities", "car_costs", "taxes_fees", "bank_fees")
GENERIC_BANK_CATEGORIES = ("other_expense", "shopping_general")
MANUAL_REASON = "set by household: not an investment"
WASTE_STATUS = {
    "expired": "Spoiled", "spoiled": "Spoiled", "disliked": "Discarded", "too_much": "Discarded",
    "other": "Discarded",
}
LEGACY_ITEM_TO_KEY = {
    "Food": "groceries", "Drinks": "beverages", "Hardware": "diy_garden", "Electronics": "electronics",
    "Medicine": "pharmacy", "Entertainment": "entertainment_events", "Travel": "trip_spending",
    "Living": "household_supplies", "Work": "work_expenses", "Books": "books_media", "Clothing": "clothing",
    "Cosmetics": "personal_care", "Deposit": "deposit", "Other": "other_expense",
}
LEGACY_BANK_TO_KEY = {
    "GROCERIES": "groceries", "DINING": "eating_out", "BENZIN": "fuel", "CHARGING": "ev_charging",
    "PARKING": "parking", "ONLINE_SHOPPING": "shopping_general", "SHOPPING": "shopping_general",
    "REMITTANCE": "remittances", "SALARY": "salary", "RETURNS": "refunds_returns",
    "OTHER_INCOME": "other_income",
}
# key | label | group | flow | fixed cost | coarse pantry category
SEED_CATEGORIES = """
groceries|Groceries|Food|expense|no|Food
beverages|Beverages & alcohol|Food|expense|no|Drinks
eating_out|Eating out & cafes|Food|expense|no|Food
takeaway|Takeaway & delivery|Food|expense|no|Food
deposit|Deposit (Pfand)|Food|expense|no|Deposit
fuel|Fuel (petrol/diesel)|Transport|expense|no|Other
ev_charging|EV charging|Transport|expense|no|Other
parking|Parking|Transport|expense|no|Other
public_transport|Public transport|Transport|expense|no|Other
taxi|Taxi & ride-hailing|Transport|expense|no|Other
car_costs|Car costs|Transport|expense|yes|Other
pharmacy|Pharmacy & medicine|Health & body|expense|no|Medicine
medical|Doctor, dental & therapy|Health & body|expense|no|Medicine
fitness|Fitness & sports|Health & body|expense|yes|Other
personal_care|Personal care|Health & body|expense|no|Cosmetics
rent|Rent & mortgage|Home|expense|yes|Living
utilities|Utilities|Home|expense|yes|Living
internet_phone|Internet & phone|Home|expense|yes|Living
household_supplies|Household supplies|Home|expense|no|Living
furniture_decor|Furniture & decor|Home|expense|no|Living
diy_garden|DIY & garden|Home|expense|no|Hardware
clothing|Clothing & shoes|Shopping|expense|no|Clothing
electronics|Electronics & appliances|Shopping|expense|no|Electronics
books_media|Books & media|Shopping|expense|no|Books
gifts|Gifts|Shopping|expense|no|Other
pets|Pets|Shopping|expense|no|Other
shopping_general|General shopping|Shopping|expense|no|Other
subscriptions|Subscriptions & streaming|Leisure|expense|yes|Entertainment
entertainment_events|Events & entertainment|Leisure|expense|no|Entertainment
hobbies|Hobbies & games|Leisure|expense|no|Entertainment
flights|Flights|Travel|expense|no|Travel
accommodation|Accommodation|Travel|expense|no|Travel
trip_spending|Trip spending|Travel|expense|no|Travel
insurance|Insurance|Finance & admin|expense|yes|Other
loans|Loans & financing|Finance & admin|expense|yes|Other
taxes_fees|Taxes, fees & fines|Finance & admin|expense|no|Other
bank_fees|Bank & card fees|Finance & admin|expense|yes|Other
education|Education & courses|Finance & admin|expense|no|Work
work_expenses|Work expenses|Finance & admin|expense|no|Work
donations|Donations & charity|Finance & admin|expense|no|Other
remittances|Remittances|Finance & admin|expense|no|Other
cash|Cash withdrawals|Finance & admin|expense|no|Other
other_expense|Other|Other|expense|no|Other
salary|Salary|Income|income|no|Other
tax_refund|Tax refund|Income|income|no|Other
refunds_returns|Refunds & returns|Income|income|no|Other
interest_dividends|Interest & dividends|Income|income|no|Other
other_income|Other income|Income|income|no|Other
"""
# End of the fixed values.
# ---------------------------------------------------------------------------------------------------------


def seed_rows() -> list[tuple]:
    rows = []
    for order, line in enumerate(SEED_CATEGORIES.strip().splitlines()):
        key, label, group, flow, fixed, _ = line.split("|")
        rows.append((key, label, group, flow, fixed == "yes", None, order * 10, True))
    return rows


def legacy_by_key() -> dict[str, str]:
    return {line.split("|")[0]: line.split("|")[5] for line in SEED_CATEGORIES.strip().splitlines()}


def seed_categories(spark) -> DataFrame:
    """The starting list as an inline table: Spark knows its size and can broadcast it."""

    def literal(value) -> str:
        if value is None:
            return "cast(NULL AS string)"
        if isinstance(value, (bool, int)):
            return str(value).lower()
        return "'" + value.replace("'", "\\'") + "'"

    rows = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in seed_rows())
    names = ", ".join(part.strip().split(" ")[0] for part in SCHEMAS["categories"].split(","))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS c({names})")
