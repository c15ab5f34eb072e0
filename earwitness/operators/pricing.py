"""Decimal price quotes with a margin floor."""

from __future__ import annotations

from dataclasses import asdict
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earwitness.functions.hashing import record_sha256
from earwitness.params import PaymentRates, PlanRates, PriceBook

MONEY = "decimal(18,2)"
AMOUNT = "decimal(30,12)"
#: Cents above the computed price that are tried; fees and tax settle in cents, so the first may fall short by a little.
CENTS_TRIED = 100


def _rate_errors(book: PriceBook) -> list[str]:
    shares = {"gst_rate": book.gst_rate, "target_margin": book.target_margin, "income_tax": book.income_tax, "contingency": book.contingency}
    shares |= {f"{name}.variable": rates.variable for name, rates in book.payments.items()}
    return [f"{name} must be at least 0 and below 1" for name, rate in shares.items() if not 0 <= rate < 1]


def _negative(name: str, rates: PlanRates | PaymentRates) -> list[str]:
    return [f"{name}.{field} must be non-negative" for field, value in asdict(rates).items() if isinstance(value, Decimal) and value < 0]


def price_book_errors(book: PriceBook) -> list[str]:
    """Violations of a price book. It is configuration, so it is checked once, on the driver."""
    found = _rate_errors(book)
    if book.currency != "SGD":
        found.append("unsupported currency")
    if not 0 < len(book.version) <= 80:
        found.append("version must have 1-80 characters")
    if not 1 <= book.valid_minutes <= 1440:
        found.append("valid_minutes must be 1-1440")
    if book.usd_rate <= 0:
        found.append("usd_rate must be positive")
    for name, rates in (*book.plans.items(), *book.payments.items()):
        found += _negative(name, rates)
    found += [f"{name} needs at least one review minute" for name, plan in book.plans.items() if plan.review_minutes_at_least is not None and plan.review_minutes_at_least < 1]
    if not found:
        found = [f"{name} leaves no selling price" for name, pay in book.payments.items() if _left_of_price(book, pay) <= 0]
    return found


def _gst(book: PriceBook) -> Decimal:
    return book.gst_rate if book.gst_registered else Decimal(0)


def _left_of_price(book: PriceBook, pay: PaymentRates) -> Decimal:
    """Share of a price that is left for costs after fees and the margin before tax."""
    return 1 - pay.variable * (1 + _gst(book)) - book.target_margin / (1 - book.income_tax)


def _rates(rows: dict[str, dict[str, Decimal | int | None | tuple]], name: Column) -> Column:
    """The rates of the named plan or payment method, as a struct of literals."""
    def literal(value) -> Column:
        if isinstance(value, Decimal):
            return F.lit(value).cast("decimal(18,10)")
        return F.array(*map(F.lit, value)).cast("array<string>") if isinstance(value, tuple) else F.lit(value).cast("int")

    pairs = [c for key, row in rows.items() for c in (F.lit(key), F.struct(*[literal(v).alias(k) for k, v in row.items()]))]
    return F.try_element_at(F.create_map(*pairs), name)


def quote_errors(book: PriceBook = PriceBook()) -> Column:
    """Faults of one order."""
    plan = F.col("plan_id")
    of_review = plan.isin(*[name for name, rates in book.plans.items() if rates.review_minutes_at_least is not None])
    of_audio = plan.isin(*[name for name, rates in book.plans.items() if rates.review_minutes_at_least is None])
    positive = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    return F.array_compact(F.array(
        F.when(~F.coalesce(plan.isin(*book.plans), F.lit(False)), F.lit("unsupported plan")),
        F.when(~F.coalesce(F.col("payment_method").isin(*book.payments), F.lit(False)), F.lit("unsupported payment method")),
        F.when(of_audio & ~positive("duration_seconds"), F.lit("duration_seconds must be positive")),
        F.when(of_review & ~positive("requested_review_minutes"), F.lit("requested_review_minutes must be positive")),
    ))


def _by_hour(minutes: Column, rate: Column) -> Column:
    return F.try_divide((minutes * rate).cast("decimal(26,10)"), F.lit(60).cast("decimal(12,6)")).cast(AMOUNT)


def _settled(price: Column, cost: Column, pay: Column, book: PriceBook) -> Column:
    """Tax, fee and profit of a price, in cents where money changes hands, and whether the margin is met."""
    exact = lambda d: F.lit(d).cast("decimal(18,6)")
    gst = F.round(price * exact(_gst(book)), 2).cast(MONEY)
    total = (price + gst).cast(MONEY)
    fee = F.round(total * pay["variable"].cast("decimal(18,6)") + pay["fixed"].cast("decimal(18,6)"), 2).cast(MONEY)
    profit = (price - cost - fee).cast(AMOUNT)
    kept = F.when(profit >= 0, (profit.cast("decimal(24,12)") * exact(1 - book.income_tax)).cast(AMOUNT)).otherwise(profit)
    meets = kept >= (price * exact(book.target_margin)).cast(AMOUNT)
    return F.struct(price.alias("price"), gst.alias("gst"), total.alias("total"), fee.alias("fee"), profit.alias("pretax"), kept.alias("after_tax"), meets.alias("meets"))


def _four(value: Decimal) -> Column:
    return F.round(F.lit(value).cast("decimal(18,10)"), 4).cast("decimal(18,4)").cast("string")


def calculation(book: PriceBook) -> Column:
    """The record that identifies a quote: every fact of its calculation, amounts as text with their cents."""
    # Names of the record.
    cents = {
        "list_price_pre_gst_sgd": "list_price_pre_gst", "price_floor_pre_gst_sgd": "price_floor_pre_gst", "price_pre_gst_sgd": "price_pre_gst",
        "gst_amount_sgd": "gst_amount", "customer_total_sgd": "customer_total", "delivery_cost_sgd": "delivery_cost",
        "payment_fee_estimate_sgd": "payment_fee_estimate", "pretax_operating_profit_sgd": "pretax_operating_profit",
        "after_tax_operating_profit_sgd": "after_tax_operating_profit"}
    costs = {
        "provider_estimate_sgd": "provider", "provider_contingency_sgd": "contingency", "infrastructure_storage_sgd": "infrastructure",
        "support_exception_reserve_sgd": "support", "product_operations_reserve_sgd": "operations", "reviewer_labor_sgd": "labor"}
    facts = {
        "price_book_version": F.lit(book.version), "plan_id": F.col("plan_id"), "payment_method": F.col("payment_method"), "currency": F.lit(book.currency),
        "billed_audio_minutes": F.col("billed_audio_minutes"), "requested_review_minutes": F.col("requested_review_minutes_rounded"),
        "billed_review_minutes": F.col("billed_review_minutes"), "provider_routes": F.col("provider_routes"),
        "costs": F.struct(*[F.round(F.col(f"costs.{part}"), 2).cast(MONEY).cast("string").alias(name) for name, part in costs.items()]),
        "after_tax_margin": F.col("after_tax_margin").cast("string"), "target_after_tax_margin": _four(book.target_margin),
        "income_tax_rate_assumption": _four(book.income_tax), "gst_registered": F.lit(book.gst_registered), "gst_rate": _four(_gst(book)),
        "usd_to_sgd_rate_assumption": _four(book.usd_rate)}
    return F.struct(*[F.col(c).cast("string").alias(name) for name, c in cents.items()], *[c.alias(name) for name, c in facts.items()])


def quote_orders(orders: DataFrame, book: PriceBook = PriceBook()) -> tuple[DataFrame, DataFrame]:
    """Quotes and rejected orders. A narrow map over orders: the price book is inlined as literals.

    ``orders``: quote_id, plan_id, payment_method, duration_seconds,
    requested_review_minutes, created_at. ``calculation_sha256`` identifies a quote by
    all facts of its calculation: minutes, routes, every cost part, tax, margin and rates.
    """
    wrong = price_book_errors(book)
    rows = orders.withColumn("errors", F.concat(quote_errors(book), F.array(*map(F.lit, wrong)).cast("array<string>")))
    bad = rows.where(F.size("errors") > 0).select(*orders.columns, "errors")
    plans = {name: asdict(rates) for name, rates in book.plans.items()}
    payments = {name: asdict(rates) | ({} if wrong else {"left": _left_of_price(book, rates)}) for name, rates in book.payments.items()}
    if wrong:
        payments = {name: row | {"left": Decimal(1)} for name, row in payments.items()}

    good = rows.where(F.size("errors") == 0).drop("errors")
    good = good.withColumn("of", F.struct(_rates(plans, F.col("plan_id")).alias("plan"), _rates(payments, F.col("payment_method")).alias("pay")))
    plan, pay = F.col("of.plan"), F.col("of.pay")
    of_review = plan["review_minutes_at_least"].isNotNull()
    # Exact minutes: ceiling of whole seconds avoids a rounded quotient.
    audio = F.when(~of_review, F.floor((F.ceil("duration_seconds") + 59) / 60)).cast("bigint")
    asked = F.when(of_review, F.ceil("requested_review_minutes")).cast("bigint")
    billed = F.when(of_review, F.greatest(asked, plan["review_minutes_at_least"].cast("bigint")))
    good = good.withColumn("asked", F.struct(audio.alias("audio"), asked.alias("rounded"), billed.alias("review")))
    minutes = F.coalesce("asked.audio", "asked.review").cast("decimal(12,0)")
    provider = (minutes * plan["usd_per_minute"].cast("decimal(18,6)") * F.lit(book.usd_rate).cast("decimal(18,6)")).cast(AMOUNT)
    parts = {
        "provider": provider, "contingency": (provider.cast("decimal(20,8)") * F.lit(book.contingency).cast("decimal(18,6)")).cast(AMOUNT),
        "infrastructure": _by_hour(minutes, plan["infrastructure_per_hour"].cast("decimal(18,6)")), "support": plan["support"].cast(AMOUNT),
        "operations": plan["operations"].cast(AMOUNT), "labor": _by_hour(minutes, plan["labor_per_hour"].cast("decimal(18,6)"))}
    asking = F.greatest(plan["minimum"].cast(AMOUNT), _by_hour(minutes, plan["list_per_hour"].cast("decimal(18,6)")))
    good = good.withColumn("costs", F.struct(*[c.alias(name) for name, c in parts.items()], asking.alias("list_price")))
    cost = sum((F.col(f"costs.{name}") for name in parts), F.lit(0).cast(AMOUNT)).cast(AMOUNT)
    good = good.withColumn("delivery", cost)
    floor = F.try_divide((F.col("delivery") + pay["fixed"]).cast("decimal(26,12)"), pay["left"].cast("decimal(11,10)")).cast("decimal(30,10)")
    good = good.withColumn("floor", floor)
    good = good.withColumn("base", F.ceil(F.greatest(F.col("costs.list_price").cast("decimal(30,10)"), F.col("floor")), 2).cast(MONEY))
    steps = F.transform(F.sequence(F.lit(1), F.lit(CENTS_TRIED)), lambda k: _settled((F.col("base") + k * F.lit(Decimal("0.01"))).cast(MONEY), F.col("delivery"), pay, book))
    good = good.withColumn("first", _settled(F.col("base"), F.col("delivery"), pay, book))
    # Almost every order settles at once; the next cents are looked at only for the rest.
    settled = F.when(F.col("first.meets"), F.col("first")).otherwise(F.try_element_at(F.filter(steps, lambda x: x["meets"]), F.lit(1)))
    # Made once: behind the explode no filter repeats the settlement. All that is used later goes through it.
    whole = F.struct(settled.alias("s"), "asked", "costs", "delivery", "floor", plan["routes"].alias("routes"))
    good = good.select(*orders.columns, F.explode(F.array(whole)).alias("of")).select(*orders.columns, "of.*")
    missed = good.where(F.col("s").isNull()).select(*orders.columns, F.array(F.lit("no price within a hundred cents of the floor meets the target margin")).alias("errors"))
    good, bad = good.where(F.col("s").isNotNull()), bad.unionByName(missed)
    margin = F.round(F.try_divide(F.col("s.after_tax").cast("decimal(24,12)"), F.col("s.price").cast("decimal(12,2)")), 4).cast("decimal(10,4)")
    cents = lambda c: F.round(c, 2).cast(MONEY)
    facts = good.select(
        "quote_id", "plan_id", "payment_method", F.col("asked.audio").alias("billed_audio_minutes"), F.col("asked.rounded").alias("requested_review_minutes_rounded"),
        F.col("asked.review").alias("billed_review_minutes"), F.col("routes").alias("provider_routes"), F.col("costs").dropFields("list_price").alias("costs"),
        cents("costs.list_price").alias("list_price_pre_gst"), cents("floor").alias("price_floor_pre_gst"),
        F.col("s.price").alias("price_pre_gst"), F.col("s.gst").alias("gst_amount"), F.col("s.total").alias("customer_total"),
        cents("delivery").alias("delivery_cost"), F.col("s.fee").alias("payment_fee_estimate"), cents("s.pretax").alias("pretax_operating_profit"),
        cents("s.after_tax").alias("after_tax_operating_profit"), margin.alias("after_tax_margin"),
        F.lit(book.version).alias("price_book_version"), F.lit(book.currency).alias("currency"), F.col("created_at"),
        (F.col("created_at") + F.make_interval(mins=F.lit(book.valid_minutes))).alias("expires_at"))
    named = facts.withColumn("calculation", calculation(book))
    return named.withColumn("calculation_sha256", record_sha256(named, "calculation", ascii_only=True)).drop("calculation"), bad
