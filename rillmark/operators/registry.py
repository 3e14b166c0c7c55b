"""What users can add by name: losses, reward managers, data sets, tools, dispatch modes, pipelines."""

from __future__ import annotations

import importlib.util
import inspect
import json
import re
from collections.abc import Callable
from functools import partial
from typing import Any, get_type_hints

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Registry:
    """Things by name.  A taken name refuses another thing; an unknown one is an error that
    says which are known.  Names are case-sensitive."""

    def __init__(self, kind: str):
        self.kind, self.held = kind, {}

    def register(self, *names: str) -> Callable[[Any], Any]:
        def put(thing: Any) -> Any:
            for name in names or (thing.__name__,):
                if self.held.setdefault(name, thing) is not thing:
                    raise ValueError(f"{self.kind} {name!r} is registered as something else")
            return thing

        return put

    def get(self, name: str) -> Any:
        if name not in self.held:
            raise ValueError(f"unknown {self.kind} {name!r}; known: {sorted(self.held)}")
        return self.held[name]


REWARD_MANAGERS = Registry("reward manager")
DISTILLATION = Registry("distillation loss")
DATASETS = Registry("data set")
TOOLS = Registry("tool")
DISPATCH = Registry("dispatch mode")
PIPELINES = Registry("pipeline")


def load(path: str, name: str) -> Any:
    """An object of a Python file."""
    spec = importlib.util.spec_from_file_location(re.sub(r"\W", "_", path), path)
    if spec is None or spec.loader is None:
        raise ValueError(f"no Python file: {path}")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    if not hasattr(module, name):
        raise ValueError(f"{path} has no {name}")
    return getattr(module, name)


def reward_function(path: str, name: str, **options: Any) -> Callable[..., Column]:
    """A user's function (source, text, truth, **options) -> number as a Column function; it runs
    in Arrow batches.  The file is read on the driver, and the function travels with the query."""
    return scored_by(partial(load(path, name), **options))


def scored_by(function: Callable[[str, str, str], float]) -> Callable[..., Column]:
    def of(source: Column, text: Column, truth: Column) -> Column:
        @F.pandas_udf("double")
        def run(s: pd.Series, t: pd.Series, g: pd.Series) -> pd.Series:
            return pd.Series([float(function(a, b, c)) for a, b, c in zip(s, t, g, strict=True)])

        return run(source, text, truth)

    return of


class Rows:
    """A user's data set: where rows of prompts come from."""

    def read(self, spark: SparkSession) -> DataFrame:
        raise NotImplementedError


def dataset(cls: type) -> type:
    """Register a data set under its class name; it must derive from ``Rows``."""
    if not (inspect.isclass(cls) and issubclass(cls, Rows)):
        raise TypeError(f"{cls!r} isn't a kind of Rows")
    return DATASETS.register(cls.__name__)(cls)


_KINDS = {str: "string", int: "integer", float: "number", bool: "boolean", list: "array", dict: "object"}


def tool(function: Callable) -> Callable:
    """Register a function as a tool; each parameter needs a type and a line 'name: what it is'
    under 'Args:' of its docstring."""
    schema(function)
    return TOOLS.register(function.__name__)(function)


def schema(function: Callable) -> dict:
    """The JSON schema of a tool, from its signature and docstring."""
    text = inspect.getdoc(function) or ""
    about, _, told = text.partition("Args:")
    says = dict(re.findall(r"^\s*(\w+)(?:\s*\([^)]*\))?:\s*(.+)$", told.partition("Returns:")[0], re.MULTILINE))
    hints, properties, required = get_type_hints(function), {}, []
    for name, p in inspect.signature(function).parameters.items():
        if hints.get(name) not in _KINDS or name not in says or not about.strip():
            raise TypeError(f"{function.__name__}: {name} needs a type and a description")
        properties[name] = {"type": _KINDS[hints[name]], "description": says[name].strip()}
        if p.default is inspect.Parameter.empty:
            required.append(name)
    return {"type": "function", "function": {"name": function.__name__, "description": about.strip(), "parameters": {"type": "object", "properties": properties, "required": required}}}


def call_tool(name: str, arguments: Column) -> Column:
    """What a tool says (as JSON) to arguments given as a JSON object; null where it fails."""
    function = TOOLS.get(name)

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        def one(text: str) -> str | None:
            try:
                return json.dumps(function(**json.loads(text)))
            except (TypeError, ValueError):
                return None

        return rows.map(one)

    return run(arguments)
