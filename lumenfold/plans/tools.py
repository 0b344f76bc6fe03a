"""Hooks and tools that users add: chained functions over DataFrames, checked calls with results as envelopes."""

from __future__ import annotations

import importlib.util
import inspect
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.operators import quality

POINTS = ("pre_index", "post_index", "pre_search", "post_search", "pre_analysis", "post_analysis", "on_validation")


@dataclass
class Plugin:
    """A name and, for each point it hooks into, a function from DataFrame to DataFrame."""

    name: str
    hooks: dict[str, Callable[[DataFrame], DataFrame]]


@dataclass
class Plugins:
    """Plugins run in the order they were registered; one that raises is skipped and its error kept."""

    held: dict[str, Plugin] = field(default_factory=dict)
    idle: set[str] = field(default_factory=set)
    errors: list[tuple[str, str, str]] = field(default_factory=list)

    def register(self, plugin: Plugin) -> None:
        """A plugin of the same name is replaced."""
        self.held[plugin.name] = plugin

    def activate(self, name: str, on: bool = True) -> None:
        self.idle = self.idle - {name} if on else self.idle | {name}

    def dispatch(self, point: str, df: DataFrame) -> DataFrame:
        for p in self.held.values():
            if point in p.hooks and p.name not in self.idle:
                try:
                    df = p.hooks[point](df)
                except Exception as e:  # noqa: BLE001  a plugin's failure must not end the query
                    self.errors.append((p.name, point, str(e)))
        return df

    def discover(self, folder: str) -> int:
        """Registers what create_plugin() of each Python file of a folder gives; files that begin with _ or fail are passed over."""
        found = 0
        for path in sorted(Path(folder).glob("[!_]*.py")):
            try:
                spec = importlib.util.spec_from_file_location(f"plugin_{path.stem}", path)
                module = importlib.util.module_from_spec(spec)
                spec.loader.exec_module(module)
                plugin = module.create_plugin()
            except Exception as e:  # noqa: BLE001
                self.errors.append((path.name, "discover", str(e)))
                continue
            if isinstance(plugin, Plugin):
                self.register(plugin)
                found += 1
        return found


def marks_plugin() -> Plugin:
    """Adds lines that wait for work to validation issues (file_path, line_number, description, severity) of files it is given."""
    return Plugin("code-marks", {"on_validation": lambda files: quality.marked_lines(files)})


def annotator_plugin(by: str = "search-annotator") -> Plugin:
    return Plugin(by, {"post_search": lambda df: df.withColumns({"annotated_by": F.lit(by), "annotated_at": F.current_timestamp()})})


@dataclass
class Outcome:
    """What a tool call gave: a DataFrame, or an error code with its message."""

    tool: str
    success: bool
    data: DataFrame | None = None
    code: str | None = None
    message: str | None = None
    millis: float = 0.0


class Executor:
    """Calls tools by name with checked arguments. Tools are functions; a parameter without a default is required."""

    def __init__(self, built_in: dict[str, Callable[..., DataFrame]]):
        self.built_in, self.own = built_in, {}

    def register(self, name: str, tool: Callable[..., DataFrame]) -> None:
        if name in self.built_in:
            raise ValueError(f"{name} exists")
        self.own[name] = tool

    def tools(self) -> dict[str, Callable[..., DataFrame]]:
        return self.built_in | self.own

    def problem(self, tool: str, arguments: dict) -> tuple[str, str] | None:
        if tool not in self.tools():
            return "unknown_tool", f"Unknown tool: {tool}"
        need = inspect.signature(self.tools()[tool]).parameters.values()
        for p in need:
            if p.default is p.empty and p.kind not in (p.VAR_KEYWORD, p.VAR_POSITIONAL) and p.name not in arguments:
                return "missing_argument", f"Missing required argument: {p.name}"
        return None

    def execute(self, tool: str, /, **arguments) -> Outcome:
        bad = self.problem(tool, arguments)
        if bad:
            return Outcome(tool, False, None, *bad)
        began = time.monotonic()
        try:
            data = self.tools()[tool](**arguments)
        except Exception as e:  # noqa: BLE001  a tool's failure is a result
            return Outcome(tool, False, None, "execution_error", str(e), (time.monotonic() - began) * 1000)
        return Outcome(tool, True, data, millis=(time.monotonic() - began) * 1000)

    def execute_batch(self, calls: list[tuple[str, dict]]) -> list[Outcome]:
        return [self.execute(tool, **arguments) for tool, arguments in calls]


def page_of(df: DataFrame, cursor: int, size: int, *order) -> tuple[DataFrame, int | None]:
    """A page and the cursor of the next one; None after the last."""
    rows = df.orderBy(*order).offset(cursor).limit(size + 1)
    more = rows.count() > size
    return rows.limit(size), cursor + size if more else None
