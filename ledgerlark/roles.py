"""Which column of a fact table plays which business role."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Roles:
    """Column names by role; a role the data does not have stays ``None``."""

    time: str | None = None
    revenue: str | None = None
    order: str | None = None
    customer: str | None = None
    product: str | None = None
    quantity: str | None = None
    categories: list[str] = field(default_factory=list)
    unit_price: str | None = None
    discount: str | None = None
    cost: str | None = None
    profit: str | None = None
    name: str | None = None
