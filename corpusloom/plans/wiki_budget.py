"""The budgets of a wiki search as one fold over a query's picked claims, inside the JVM.

A query's claims arrive as one array in page and pick order: some dozens of pages with a dozen claims each at most, so
the array is bounded whatever the corpus. The fold carries a small struct from claim to claim:

| field | meaning |
| --- | --- |
| `page` | order of the page the last claim stood on |
| `open` | whether that page may take further claims |
| `taken` | claims admitted from it |
| `pages` | pages with an admitted claim |
| `claims` | claims admitted so far |
| `left` | characters left, never below zero |
| `over` | nothing further is admitted |
| `reason` | why something was left out |
| `kept` | places of the admitted claims in the array |

Entering a page: without characters left the search is over (`character_budget`); with the page or claim limit reached
it is over too, for `claim_limit` unless a reason is known. A claim longer than what is left closes its page
(`character_budget`) unless nothing was admitted before it. A search that ends by itself with pages left over reports
`page_limit` or `claim_limit`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

STATE = (
    "struct<page:bigint,open:boolean,taken:int,pages:int,claims:int,left:bigint,over:boolean,reason:string,kept:array<int>>"
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _state(**fields: Column) -> Column:
    return F.struct(*(value.alias(name) for name, value in fields.items())).cast(STATE)


def _enter(s: Column, row: Column, page_limit: int, claim_limit: int) -> Column:
    """The state before a claim: another page than the last one is opened, or the search ends there."""
    fresh = ~s["over"] & (row["page_order"] != s["page"])
    spent = fresh & (s["left"] <= 0)
    full = fresh & ~spent & ((s["pages"] >= page_limit) | (s["claims"] >= claim_limit))
    reason = F.when(spent, F.lit("character_budget")).when(full, F.coalesce(s["reason"], F.lit("claim_limit")))
    return _state(
        page=row["page_order"].cast("long"),
        open=fresh | s["open"],
        taken=F.when(fresh, 0).otherwise(s["taken"]),
        pages=s["pages"],
        claims=s["claims"],
        left=s["left"],
        over=s["over"] | spent | full,
        reason=F.coalesce(reason, s["reason"]),
        kept=s["kept"],
    )


def _offer(s: Column, row: Column, at: Column, per_page: Column, claim_limit: int) -> Column:
    """The state after a claim, which is admitted, closes its page, or is passed over."""
    wanted = ~s["over"] & s["open"] & row["cost"].isNotNull() & (s["taken"] < per_page) & (s["claims"] < claim_limit)
    too_long = (row["cost"] > s["left"]) & (s["pages"] > 0)
    admit, close = F.coalesce(wanted & ~too_long, F.lit(False)), F.coalesce(wanted & too_long, F.lit(False))
    one = admit.cast("int")
    return _state(
        page=s["page"],
        open=s["open"] & ~close,
        taken=s["taken"] + one,
        pages=s["pages"] + (admit & (s["taken"] == 0)).cast("int"),
        claims=s["claims"] + one,
        left=F.when(admit, F.greatest(F.lit(0), s["left"] - row["cost"])).otherwise(s["left"]),
        over=s["over"],
        reason=F.when(close, F.lit("character_budget")).otherwise(s["reason"]),
        kept=F.when(admit, F.array_append(s["kept"], at)).otherwise(s["kept"]),
    )


def admitted(rows: Column, page_limit: int, claim_limit: int, per_page: int, budget: int) -> Column:
    """struct(kept, reason) of an array of (page_order, cost, ...) in order; a page without claims has a null cost.

    `kept` holds places from 1. A query with a single page may fill all its claims from it.
    """
    pages = F.size(F.array_distinct(F.transform(rows, lambda r: r["page_order"])))
    limit = F.when(pages == 1, claim_limit).otherwise(per_page)
    start = _state(
        page=F.lit(-1),
        open=F.lit(True),
        taken=F.lit(0),
        pages=F.lit(0),
        claims=F.lit(0),
        left=F.lit(budget),
        over=F.lit(False),
        reason=F.lit(None),
        kept=F.array().cast("array<int>"),
    )
    numbered = F.transform(rows, lambda r, i: F.struct(r["page_order"].alias("page_order"), r["cost"].alias("cost"), (i + 1).alias("at")))

    def step(s: Column, row: Column) -> Column:
        return _let(_enter(s, row, page_limit, claim_limit), lambda entered: _offer(entered, row, row["at"], limit, claim_limit))

    def told(s: Column) -> Column:
        unseen = F.when(s["pages"] < pages, F.when(s["pages"] >= page_limit, "page_limit").otherwise("claim_limit"))
        reason = F.when(s["left"] <= 0, F.lit("character_budget")).otherwise(F.coalesce(s["reason"], unseen))
        return F.struct(s["kept"].alias("kept"), reason.alias("reason"))

    return F.aggregate(numbered, start, step, told)
