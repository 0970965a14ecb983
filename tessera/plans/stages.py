"""A graph of stages: targets with sources and an action; what is up to date is not run again."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field


@dataclass
class Stage:
    target: str
    sources: list[str]
    action: Callable[[], None]
    note: str = ""


@dataclass
class Graph:
    """Stages by target; a target that is made twice is an error."""

    stages: dict[str, Stage] = field(default_factory=dict)

    def add(self, target: str, sources: list[str], action: Callable[[], None], note: str = "") -> None:
        if target in self.stages:
            raise ValueError(f"target {target!r} is made twice")
        self.stages[target] = Stage(target, sources, action, note)

    def levels(self, goals: list[str] | None = None) -> list[list[str]]:
        """Targets in an order of work: those of one level do not depend on each other."""
        depth: dict[str, int] = {}

        def of(t: str, path: tuple[str, ...] = ()) -> int:
            if t in path:
                raise ValueError(f"targets depend on themselves: {' -> '.join((*path, t))}")
            if t not in self.stages:
                return -1
            if t not in depth:
                depth[t] = 1 + max((of(s, (*path, t)) for s in self.stages[t].sources), default=-1)
            return depth[t]

        for t in goals or list(self.stages):
            of(t)
        out: list[list[str]] = [[] for _ in range(max(depth.values(), default=-1) + 1)]
        for t, d in depth.items():
            out[d].append(t)
        return out

    def describe(self, goals: list[str] | None = None) -> str:
        """The plan as text: a dry run."""
        return "\n".join(f"{t}: {' '.join(self.stages[t].sources)}" + (f"  # {self.stages[t].note}" if self.stages[t].note else "") for level in self.levels(goals) for t in level)

    def run(self, goals: list[str] | None = None, done: Callable[[str], bool] = lambda t: False, jobs: int = 1) -> list[str]:
        """Run what is not done; a stage runs if its target is missing or a source was made anew. Stages of a level run side by side."""
        made: list[str] = []
        for level in self.levels(goals):
            due = [t for t in level if not done(t) or any(s in made for s in self.stages[t].sources)]
            with ThreadPoolExecutor(max(1, jobs)) as pool:
                list(pool.map(lambda t: self.stages[t].action(), due))
            made += due
        return made
