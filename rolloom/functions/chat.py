"""Rendering chat messages to text."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """What goes before and after a message, per role; ``{role}`` stands for the role."""

    prefix: str = "<|{role}|>"
    suffix: str = "<|end|>"
    prefixes: dict[str, str] = field(default_factory=dict)
    suffixes: dict[str, str] = field(default_factory=dict)

    def before(self, role: Column) -> Column:
        return self._lookup(role, self.prefix, self.prefixes)

    def after(self, role: Column) -> Column:
        return self._lookup(role, self.suffix, self.suffixes)

    @staticmethod
    def _lookup(role: Column, default: str, special: dict[str, str]) -> Column:
        result = F.replace(F.lit(default), F.lit("{role}"), role) if "{role}" in default else F.lit(default)
        for name, text in special.items():
            result = F.when(role == name, F.lit(text)).otherwise(result)
        return result

    def message(self, m: Column) -> Column:
        return F.concat(self.before(m["role"]), m["content"], self.after(m["role"]))

    def render(self, messages: Column) -> Column:
        return F.array_join(F.transform(messages, self.message), "")

    def prompt_text(self, messages: Column, completion: Column) -> Column:
        """The prompt up to and including the opening of the completion's first message."""
        return F.concat(self.render(messages), self.before(F.get(completion, 0)["role"]))

    def completion_text(self, completion: Column) -> Column:
        """What follows ``prompt_text`` in the rendering of the whole exchange."""
        first = F.get(completion, 0)
        opening = F.concat(first["content"], self.after(first["role"]))
        return F.concat(opening, self.render(F.slice(completion, 2, F.greatest(F.size(completion) - 1, F.lit(0)))))
