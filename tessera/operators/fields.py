"""Standard fundamental fields and the filing concepts that stand for them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Field:
    """Concepts by priority, the unit, whether values belong to a date or a span, and whether spans can be added."""

    concepts: tuple[str, ...]
    unit: str
    kind: str
    additive: bool = False


def _flow(*names: str) -> Field:
    return Field(tuple(f"us-gaap:{n}" for n in names), "USD", "duration", True)


def _stock(*names: str) -> Field:
    return Field(tuple(f"us-gaap:{n}" for n in names), "USD", "instant")


# The concepts of each field in order of priority.
FIELDS: dict[str, Field] = {
    "revenue": _flow(
        "RevenuesNetOfInterestExpense",
        "Revenues",
        "RevenueFromContractWithCustomerExcludingAssessedTax",
        "RevenueFromContractWithCustomerIncludingAssessedTax",
        "SalesRevenueNet",
    ),
    "cost_of_revenue": _flow("CostOfRevenue", "CostOfGoodsAndServicesSold", "CostOfGoodsSold", "CostOfServices"),
    "gross_profit": _flow("GrossProfit"),
    "rd_expense": _flow("ResearchAndDevelopmentExpense"),
    "operating_income": _flow("OperatingIncomeLoss"),
    "interest_expense": _flow("InterestExpense"),
    "pretax_income": _flow(
        "IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest",
        "IncomeLossFromContinuingOperationsBeforeIncomeTaxesMinorityInterestAndIncomeLossFromEquityMethodInvestments",
    ),
    "income_tax": _flow("IncomeTaxExpenseBenefit"),
    "net_income": _flow("NetIncomeLoss", "NetIncomeLossAvailableToCommonStockholdersBasic", "ProfitLoss"),
    "eps_basic": Field(("us-gaap:EarningsPerShareBasic", "us-gaap:EarningsPerShareBasicAndDiluted"), "USD/shares", "duration"),
    "eps_diluted": Field(("us-gaap:EarningsPerShareDiluted", "us-gaap:EarningsPerShareBasicAndDiluted"), "USD/shares", "duration"),
    "shares_diluted_avg": Field(("us-gaap:WeightedAverageNumberOfDilutedSharesOutstanding",), "shares", "duration"),
    "total_assets": _stock("Assets"),
    "current_assets": _stock("AssetsCurrent"),
    "cash": _stock("CashAndCashEquivalentsAtCarryingValue", "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents", "Cash"),
    "total_liabilities": _stock("Liabilities"),
    "current_liabilities": _stock("LiabilitiesCurrent"),
    "long_term_debt": _stock("LongTermDebtNoncurrent", "LongTermDebt"),
    "total_equity": _stock("StockholdersEquity", "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"),
    "shares_outstanding": Field(("dei:EntityCommonStockSharesOutstanding", "us-gaap:CommonStockSharesOutstanding"), "shares", "instant"),
    "operating_cash_flow": _flow("NetCashProvidedByUsedInOperatingActivities", "NetCashProvidedByUsedInOperatingActivitiesContinuingOperations"),
    "capex": _flow("PaymentsToAcquirePropertyPlantAndEquipment", "PaymentsToAcquireProductiveAssets"),
    "depreciation_amortization": _flow(
        "DepreciationDepletionAndAmortization", "DepreciationAmortizationAndAccretionNet", "DepreciationAndAmortization"
    ),
    "dividends_paid": _flow("PaymentsOfDividends", "PaymentsOfDividendsCommonStock"),
    "share_repurchase": _flow("PaymentsForRepurchaseOfCommonStock"),
}

#: Concepts by ticker and field that go before the table's; none are known.
TICKER_FIELD_OVERRIDES: dict[str, dict[str, tuple[str, ...]]] = {}


def get_field_concepts(field: str, ticker: str | None = None) -> tuple[str, ...]:
    """The concepts of a field by priority; an unknown field is a KeyError."""
    own = TICKER_FIELD_OVERRIDES.get((ticker or "").upper(), {}).get(field)
    return tuple(own) if own else FIELDS[field].concepts


def concept_table(spark: SparkSession, fields: list[str] | None = None) -> DataFrame:
    """(field, concept, unit, kind, additive, priority, ticker): one row per candidate; ticker is null but for overrides."""
    rows = []
    for name in fields if fields is not None else FIELDS:
        spec = FIELDS[name]
        rows += [(name, c, spec.unit, spec.kind, spec.additive, k, None) for k, c in enumerate(spec.concepts)]
        for ticker, own in TICKER_FIELD_OVERRIDES.items():
            rows += [(name, c, spec.unit, spec.kind, spec.additive, k, ticker) for k, c in enumerate(own.get(name, ()))]
    schema = "field string, concept string, unit string, kind string, additive boolean, priority int, only_ticker string"
    return spark.createDataFrame(rows, schema)
