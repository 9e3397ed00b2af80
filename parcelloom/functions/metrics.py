"""District metrics as Column expressions, and the registry of their names."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

_INF = float("inf")


def population_deviation(total: Column, average: Column) -> Column:
    return total / average - 1.0


def smooth_deviation(deviation: Column, districts: Column | int) -> Column:
    """1 at no deviation, falling to 0 at the limit (1 below, one less than the number of districts above); null if there is no limit."""
    n = districts if isinstance(districts, Column) else F.lit(districts)
    limit = F.when(deviation <= 0, F.lit(1.0)).otherwise(F.when(n > 1, (n - 1).cast("double")))
    d2 = deviation * deviation
    return (1.0 - d2 / (limit * limit)) / (1.0 + d2)


def sharp_deviation(deviation: Column) -> Column:
    return F.least(1.0 - F.abs(deviation), F.lit(1.0))


def minority_opportunity(minority: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(0.0)).otherwise(F.try_divide(minority.cast("double"), total))


def polsby_popper(area: Column, perimeter: Column) -> Column:
    return F.when(perimeter == 0, F.lit(_INF)).otherwise(F.try_divide(4 * math.pi * area, perimeter * perimeter))


def schwartzberg(area: Column, perimeter: Column) -> Column:
    return F.when(perimeter == 0, F.lit(_INF)).otherwise(F.try_divide(2 * math.pi * F.sqrt(area / math.pi), perimeter))


def partisan_lean(dem: Column, rep: Column) -> Column:
    return F.when(dem + rep == 0, F.lit(0.0)).otherwise(F.try_divide((dem - rep).cast("double"), dem + rep))


def competitive_binary(lean: Column, threshold: float) -> Column:
    return F.when(F.abs(lean) / 2 <= threshold, 1.0).otherwise(0.0)


def competitive_quadratic(lean: Column, threshold: float) -> Column:
    half = F.abs(lean) / 2
    return F.when(half <= threshold, 1.0 - 2.0 / threshold * half * half).otherwise(2.0 / (0.5 - threshold) * (0.5 - half) * (0.5 - half))


def competitive_gaussian(lean: Column, sigma: float) -> Column:
    half = F.abs(lean) / 2
    return F.exp(-(half * half) / (2.0 * sigma * sigma))


@dataclass(frozen=True)
class Metric:
    """A metric by its kind, the series it reads and its parameters; ``column`` is its value for a district."""

    kind: str
    series: tuple[str, ...] = ()
    parameter: float = 0.0

    @staticmethod
    def deviation(series: str) -> "Metric":
        return Metric("population_deviation", (series,))

    @staticmethod
    def deviation_absolute(series: str) -> "Metric":
        return Metric("population_deviation_absolute", (series,))

    @staticmethod
    def deviation_smooth(series: str) -> "Metric":
        return Metric("population_deviation_smooth", (series,))

    @staticmethod
    def deviation_sharp(series: str) -> "Metric":
        return Metric("population_deviation_sharp", (series,))

    @staticmethod
    def compactness() -> "Metric":
        return Metric("compactness_polsby_popper", ("area_m2",))

    @staticmethod
    def schwartzberg() -> "Metric":
        return Metric("compactness_schwartzberg", ("area_m2",))

    @staticmethod
    def lean(dem: str, rep: str) -> "Metric":
        return Metric("partisan_lean", (dem, rep))

    @staticmethod
    def binary(dem: str, rep: str, threshold: float) -> "Metric":
        return Metric("competitiveness_binary", (dem, rep), threshold)

    @staticmethod
    def quadratic(dem: str, rep: str, threshold: float) -> "Metric":
        return Metric("competitiveness_quadratic", (dem, rep), threshold)

    @staticmethod
    def gaussian(dem: str, rep: str, sigma: float) -> "Metric":
        return Metric("competitiveness_gaussian", (dem, rep), sigma)

    def column(self) -> Column:
        """The value from a district's row: its totals by series, ``perimeter``, ``n`` districts and ``region_<series>``."""
        s = [F.col(x).cast("double") for x in self.series]
        if self.kind.startswith("population"):
            d = population_deviation(s[0], F.col(f"region_{self.series[0]}") / F.col("n"))
            return {"population_deviation": d, "population_deviation_absolute": F.abs(d), "population_deviation_smooth": smooth_deviation(d, F.col("n")), "population_deviation_sharp": sharp_deviation(d)}[self.kind]
        if self.kind == "compactness_polsby_popper":
            return polsby_popper(s[0], F.col("perimeter"))
        if self.kind == "compactness_schwartzberg":
            return schwartzberg(s[0], F.col("perimeter"))
        lean = partisan_lean(*s)
        if self.kind == "partisan_lean":
            return lean
        return {"competitiveness_binary": competitive_binary, "competitiveness_quadratic": competitive_quadratic, "competitiveness_gaussian": competitive_gaussian}[self.kind](lean, self.parameter)

    def __str__(self) -> str:
        return f"{self.kind}({', '.join([*self.series, *([str(self.parameter)] if self.parameter else [])])})"


@dataclass
class Objective:
    """A weighted average of metrics' scores; 0 if the weights don't add up to more than 0."""

    metrics: list[Metric]
    weights: list[float] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.set_weights(self.weights or [1.0] * len(self.metrics))

    def set_weights(self, weights: list[float]) -> None:
        if len(weights) != len(self.metrics):
            raise ValueError("one weight for each metric")
        self.weights = [float(w) for w in weights]

    def column(self) -> Column:
        """The value from a row of scores named by the metrics' numbers, ``s0``, ``s1`` and so on."""
        total = sum(self.weights)
        if total <= 0:
            return F.lit(0.0)
        return sum((F.col(f"s{i}") * w for i, w in enumerate(self.weights)), F.lit(0.0)) / total
