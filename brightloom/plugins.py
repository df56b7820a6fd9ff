"""Hooks around queries: plain functions by point and priority, with a policy for failures."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

POINTS = ("before_parse", "after_parse", "before_plan", "after_plan", "before_execute", "after_execute", "stream_batch_start", "stream_batch_end")
CONTINUE, BLOCK, FALLBACK, ABORT = "continue", "block", "fallback", "abort"


class PluginBlocked(RuntimeError):
    """A hook stopped the query."""


@dataclass
class Outcome:
    action: str = CONTINUE
    sql: str | None = None
    reason: str = ""


@dataclass
class Plugin:
    name: str
    hooks: dict[str, Callable[[dict], Outcome | None]]
    priority: int = 0
    enabled: bool = True
    fail_open: bool = True
    auto_disable_after: int = 0
    failures: int = 0


@dataclass
class PluginManager:
    enabled: bool = True
    plugins: list[Plugin] = field(default_factory=list)
    trace: list[tuple[str, str, str]] = field(default_factory=list)

    def register(self, plugin: Plugin) -> None:
        unknown = set(plugin.hooks) - set(POINTS)
        if unknown:
            raise ValueError(f"unknown hook points: {sorted(unknown)}")
        self.plugins = sorted([p for p in self.plugins if p.name != plugin.name] + [plugin], key=lambda p: -p.priority)

    def unregister(self, name: str) -> None:
        self.plugins = [p for p in self.plugins if p.name != name]

    def run(self, point: str, context: dict) -> dict:
        """The context after all hooks of a point; a hook may rewrite its sql, or end the query."""
        if not self.enabled:
            return context
        for p in [p for p in self.plugins if p.enabled and point in p.hooks]:
            try:
                got = p.hooks[point](context) or Outcome()
            except Exception as e:
                p.failures += 1
                self.trace.append((point, p.name, f"failed: {e}"))
                if p.auto_disable_after and p.failures >= p.auto_disable_after:
                    p.enabled = False
                if not p.fail_open:
                    raise
                continue
            self.trace.append((point, p.name, got.action))
            if got.action in (BLOCK, ABORT):
                raise PluginBlocked(got.reason or f"{p.name}: {got.action}")
            if got.action == FALLBACK:
                break
            if got.sql is not None:
                context = context | {"sql": got.sql}
        return context
