"""Domain generalization hierarchies: trees of category labels."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

ROOT = "<ROOT>"


class Hierarchy:
    """A tree of labels, built from paths root to leaf (without the root itself)."""

    def __init__(self, paths: Iterable[Sequence[str]] = (), root: str = ROOT):
        self.root = root
        self.parent: dict[str, str | None] = {root: None}
        self.children: dict[str, list[str]] = {root: []}
        self._leaves: dict[str, int] = {}
        for p in paths:
            self.add_path(p)

    def __contains__(self, label: str) -> bool:
        return label in self.parent

    def _attach(self, label: str, parent: str) -> None:
        self.parent[label] = parent
        self.children[label] = []
        self.children[parent].append(label)
        self._leaves.clear()

    def add_path(self, path: Sequence[str]) -> None:
        """Grafts a path below the lowest of its labels that is known, or below the root."""
        known = next((i for i in range(len(path) - 1, -1, -1) if path[i] in self), -1)
        above = path[known] if known >= 0 else self.root
        for label in path[known + 1 :]:
            self._attach(label, above)
            above = label

    def add_name(self, label: str) -> None:
        """An unknown label becomes a child of the root."""
        if label not in self:
            self._attach(label, self.root)

    def path(self, label: str) -> tuple[str, ...]:
        """Labels from below the root to the label; an unknown one is its own path."""
        out = []
        at: str | None = label
        while at is not None and at != self.root:
            out.append(at)
            at = self.parent.get(at)
        return tuple(reversed(out))

    def leaves(self, label: str) -> int:
        """Leaves below a label; a label without children is one."""
        if label not in self._leaves:
            below = self.children.get(label, [])
            self._leaves[label] = sum(map(self.leaves, below)) if below else 1
        return self._leaves[label]

    def loss(self, label: str, extra: int = 0) -> float:
        """Share of the domain's other leaves that a label covers; ``extra`` unknown leaves belong to the root."""
        if label not in self:
            return 0.0
        total = self.leaves(self.root) if self.children[self.root] else 0
        total += extra
        own = self.leaves(label) if label != self.root else total
        return (own - 1) / (total - 1) if total > 1 else 0.0

    def rows(self) -> list[tuple[str, list[str], int]]:
        """(label, path, leaves) of all labels but the root, for lookups and broadcast joins."""
        return [(n, list(self.path(n)), self.leaves(n)) for n in self.parent if n != self.root]
