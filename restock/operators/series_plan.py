"""The order problem of single series (product, store) under given capacity prices.

A series has a stock, a demand a day, days on which it may order, and links to workshops with package sizes.
Each day it orders whole packages, at most up to the highest opening level, then meets demand from what lies
above the safety stock. The cheapest decisions follow from a table of the costs to go by (day, stock); many
series are solved side by side in numpy. Above the highest level a series orders nothing and meets all it can.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Weights:
    """Levels and cost weights of one unit (a package for ``package``)."""

    max_opening: int
    overstock_level: int
    understock_level: int
    safety_stock: int
    unmet: float
    overstock: float
    understock: float
    package: float

    def opening_cost(self, opening: np.ndarray) -> np.ndarray:
        over = np.maximum(opening - self.overstock_level, 0)
        under = np.maximum(self.understock_level - opening, 0)
        return self.overstock * over + self.understock * under


@dataclass(frozen=True)
class SeriesBatch:
    """``n`` series, ``k`` links at most (package size 0: no link), ``t`` days."""

    stock: np.ndarray  # n
    demand: np.ndarray  # n, t
    allowed: np.ndarray  # n, t
    size: np.ndarray  # n, k
    cost: np.ndarray  # n, k: of a package
    price: np.ndarray  # n, k, t: of a unit of capacity
    limit: np.ndarray  # n, k, t: units that the workshop can give
    fixed: np.ndarray  # n, t: units that are delivered anyway


@dataclass(frozen=True)
class SeriesPlans:
    value: np.ndarray  # n: least cost, with prices
    own_cost: np.ndarray  # n: the same decisions without prices
    idle_cost: np.ndarray  # n: without any order
    packages: np.ndarray  # n, k, t
    opening: np.ndarray  # n, t
    met: np.ndarray  # n, t


def delivery_costs(batch: SeriesBatch, day: int, weights: Weights) -> tuple[np.ndarray, list[np.ndarray]]:
    """Least cost of each delivered amount on a day, and the packages that each link adds to it."""
    n, top = len(batch.stock), weights.max_opening
    amounts = np.arange(top + 1)
    costs = np.full((n, top + 1), np.inf)
    costs[:, 0] = 0.0
    picks = []
    for link in range(batch.size.shape[1]):
        size = batch.size[:, link]
        most = np.where((size > 0) & batch.allowed[:, day], np.minimum(top, batch.limit[:, link, day]) // np.maximum(size, 1), 0)
        unit = size * batch.price[:, link, day] + weights.package * batch.cost[:, link]
        best, pick = costs.copy(), np.zeros((n, top + 1), np.int16)
        for packages in range(1, int(most.max(initial=0)) + 1):
            at = amounts[None, :] - (packages * size)[:, None]
            other = np.take_along_axis(costs, np.maximum(at, 0), 1) + (packages * unit)[:, None]
            better = (at >= 0) & (packages <= most)[:, None] & (other < best)
            best[better] = other[better]
            pick[better] = packages
        costs = best
        picks.append(pick)
    return costs, picks


def solve(batch: SeriesBatch, weights: Weights, with_idle: bool = True) -> SeriesPlans:
    """The cheapest decisions of each series on its own; ``idle_cost`` is 0 without ``with_idle``."""
    n, days = batch.demand.shape
    top, safety = weights.max_opening, weights.safety_stock
    opening_cost = weights.opening_cost(np.arange(top + 1))
    togo = np.zeros((n, top + 1))
    idle = np.zeros((n, top + 1))
    steps = []
    for day in range(days - 1, -1, -1):
        demand = batch.demand[:, day].astype(np.int64)
        after, serve = _serve(togo, demand, weights)
        after = _shift(after + opening_cost, batch.fixed[:, day])
        if with_idle:
            idle = _shift(_serve(idle, demand, weights)[0] + opening_cost, batch.fixed[:, day])
        costs, picks = delivery_costs(batch, day, weights)
        togo, order = after.copy(), np.zeros((n, top + 1), np.int16)
        for units in np.flatnonzero(np.isfinite(costs).any(0))[1:]:
            other = costs[:, units, None] + after[:, units:]
            here = togo[:, : top + 1 - units]
            better = other < here
            here[better] = other[better]
            order[:, : top + 1 - units][better] = units
        steps.append((day, order, serve, picks, togo, idle))
    every = np.arange(n)
    stock, value, idle_cost = batch.stock.astype(np.int64), np.zeros(n), np.zeros(n)
    own, entered = np.zeros(n), np.zeros(n, bool)
    opening, met = np.zeros((n, days), np.int64), np.zeros((n, days), np.int64)
    packages = np.zeros((n, batch.size.shape[1], days), np.int64)
    for day, order, serve, picks, here, alone in reversed(steps):
        inside = stock <= top
        at = np.minimum(stock, top)
        first = inside & ~entered
        value[first] += here[every, at][first]
        idle_cost[first] += alone[every, at][first]
        entered |= inside
        left = np.where(inside, order[every, at], 0).astype(np.int64)
        opening[:, day] = stock + left + batch.fixed[:, day]
        for link in range(len(picks) - 1, -1, -1):
            some = picks[link][every, left].astype(np.int64)
            packages[:, link, day] = some
            left = left - some * batch.size[:, link]
        demand = batch.demand[:, day]
        most = np.minimum(demand, np.maximum(opening[:, day] - safety, 0))
        met[:, day] = np.where(inside, serve[every, np.minimum(opening[:, day], top)], most)
        spent = weights.unmet * (demand - met[:, day]) + weights.opening_cost(opening[:, day])
        own += spent + weights.package * (packages[:, :, day] * batch.cost).sum(1)
        value[~entered] += spent[~entered]
        idle_cost[~entered] += spent[~entered]
        stock = opening[:, day] - met[:, day]
    return SeriesPlans(value, own, idle_cost, packages, opening, met)


def _shift(costs: np.ndarray, units: np.ndarray) -> np.ndarray:
    """Costs by the stock before ``units`` are added; beyond the highest level there is no way."""
    at = np.arange(costs.shape[1])[None, :] + units[:, None]
    inside = at < costs.shape[1]
    return np.where(inside, np.take_along_axis(costs, np.where(inside, at, 0), 1), np.inf)


def _serve(togo: np.ndarray, demand: np.ndarray, weights: Weights) -> tuple[np.ndarray, np.ndarray]:
    """Least cost by opening stock and the demand met; what is met lies above the safety stock."""
    top, safety = weights.max_opening, weights.safety_stock
    best = togo + (weights.unmet * demand)[:, None]
    serve = np.zeros(togo.shape, np.int16)
    for units in range(1, min(int(demand.max(initial=0)), top - safety) + 1):
        other = togo[:, safety : top + 1 - units] + (weights.unmet * (demand - units))[:, None]
        here = best[:, safety + units :]
        better = (demand >= units)[:, None] & (other <= here)
        here[better] = other[better]
        serve[:, safety + units :][better] = units
    return best, serve
