"""The contract of operators: what they need is checked when the plan is built, and a fitted state is explicit."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame


class Operator:
    """A step from panel to panel. Give it a function, or override fit and transform.

    Columns are added, never taken away, and rows stay.
    """

    inputs: tuple[str, ...] = ()

    def __init__(self, function: Callable[..., DataFrame] | None = None, name: str | None = None, description: str | None = None, inputs: tuple[str, ...] = (), **params):
        self.function, self.params = function, params
        self.name = name or (function.__name__ if function else type(self).__name__)
        self.description, self.id, self.is_fitted = description, uuid.uuid4().hex, False
        self.inputs = inputs or self.inputs

    def validate_inputs(self, df: DataFrame) -> None:
        if missing := sorted(set(self.inputs) - set(df.columns)):
            raise ValueError(f"{self.name} needs the columns {missing}")

    def fit(self, df: DataFrame) -> Operator:
        self.validate_inputs(df)
        self.is_fitted = True
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        self.validate_inputs(df)
        return self.function(df, **self.params)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def compute(self, df: DataFrame) -> DataFrame:
        """transform, fitted first where it isn't."""
        return (self if self.is_fitted else self.fit(df)).transform(df)

    def align(self, previous: dict | None) -> None:
        """For states that are matched to those of the window before; nothing by default."""

    def get_metadata(self) -> dict:
        return {"name": self.name, "description": self.description, "class": type(self).__name__, "id": self.id, "inputs": list(self.inputs), "params": self.params, "is_fitted": self.is_fitted}


class Pipeline:
    """Operators in order. They are composed into one plan; the optimizer sees it whole."""

    def __init__(self, steps: list[tuple[str, Operator]]):
        if len({n for n, _ in steps}) != len(steps):
            raise ValueError("step names must differ")
        self.steps = list(steps)

    def fit(self, df: DataFrame) -> Pipeline:
        for _, s in self.steps:
            df = s.fit(df).transform(df)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        for _, s in self.steps:
            df = s.transform(df)
        return df

    def fit_transform(self, df: DataFrame) -> DataFrame:
        for _, s in self.steps:
            df = s.fit_transform(df)
        return df

    compute = fit_transform

    def __getitem__(self, name: str) -> Operator:
        return dict(self.steps)[name]


def dispatch(kind: str, methods: dict[str, Callable]) -> Callable:
    """A factory: its first argument names the method."""

    def call(df: DataFrame, method: str, **params) -> DataFrame:
        if method not in methods:
            raise ValueError(f"no such {kind}: {method}; there are {sorted(methods)}")
        return methods[method](df, **params)

    call.__name__ = kind
    call.methods = methods
    return call
