"""Rules per column, and the parameters of an anonymizer."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from .functions.generalizers import Generalizer, Reduction


@dataclass(frozen=True)
class Rule:
    """How one column is generalized, whether it is sensitive, and its weight in the information loss.

    A weight of 0 or less is 0.
    """

    column: str
    generalizer: Generalizer | None
    sensitive: bool = False
    weight: float = 0.0

    def __post_init__(self):
        object.__setattr__(self, "weight", max(0.0, float(self.weight)))


@dataclass(frozen=True)
class RuleSet:
    """Rules by column of a schema with fixed order."""

    columns: tuple[str, ...]
    rules: tuple[Rule, ...] = ()

    @classmethod
    def of(cls, columns, *rules: Rule) -> RuleSet:
        out = cls(tuple(columns))
        for r in rules:
            out = out.upsert(r)
        return out

    def upsert(self, rule: Rule) -> RuleSet:
        """Sets a column's rule.

        A rule without generalizer is ignored. Columns before the last one with a rule that have none are masked by
        suffix. A column may be named, or given by its position.
        """
        name = self.columns[rule.column] if isinstance(rule.column, int) else rule.column
        if name not in self.columns:
            raise ValueError(f"no column {name!r}")
        have = {r.column: r for r in self.rules}
        last = max([self.columns.index(name), *(self.columns.index(c) for c in have)])
        if rule.generalizer is not None:
            have[name] = replace(rule, column=name)
        for c in self.columns[: last + 1]:
            have.setdefault(c, Rule(c, Reduction()))
        return replace(self, rules=tuple(have[c] for c in self.columns if c in have))

    @property
    def sensitive(self) -> tuple[str, ...]:
        return tuple(r.column for r in self.rules if r.sensitive)

    @property
    def quasi_identifiers(self) -> tuple[Rule, ...]:
        return tuple(r for r in self.rules if not r.generalizer.passes)


#: Ways to render rows that can't be grouped.
SUPPRESS_DROP, SUPPRESS_NULL, SUPPRESS_MAX = 0, 1, 2


@dataclass(frozen=True)
class AnonymizerConfig:
    """k distinct subjects and l sensitive values per released group; delay delta, bounds beta and zeta, window mu."""

    subject: str
    k: int = 5
    l: int = 2  # noqa: E741
    delta: int = 200
    beta: int = 50
    zeta: int = 10
    mu: int = 10
    suppress: int = SUPPRESS_MAX
    show_info_loss: bool = False
    seed: int = 0
    #: The loss window starts with ten zeros and is never shorter; else it has exactly mu places.
    wide_window: bool = True
    #: Ranges beyond a declared domain widen it, for losses and suppressed rows; else both keep to the domain as declared.
    widen: bool = False
    #: What becomes of rows still held when the input ends: "none" keeps them back, "release" groups or suppresses them.
    flush: str = "none"
    order: tuple[str, ...] = field(default=())
    shards: int = 1

    def validate(self, rules: RuleSet) -> None:
        if self.l > 0 and not rules.sensitive:
            raise ValueError("l > 0 needs a sensitive column")
        if self.flush not in ("none", "release"):
            raise ValueError(f"unknown flush {self.flush!r}")
        if self.shards < 1:
            raise ValueError("at least one shard is needed")
