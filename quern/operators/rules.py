"""Intents from a table of rules: one pass of an automaton over a text tells which rules can apply, the first that does decides.

All literals of all rules are one Aho-Corasick automaton. A pattern is tried only where a literal that each of its
matches must hold was met (``literals_of`` finds such a set for a pattern; patterns without one are always tried), and only
while no rule of a lower priority has matched. So a text costs its length and the few patterns that can match, however many rules there are.

A rule is (priority, intent, kind, pattern, min_words, max_words); the bounds on a message's words may be null. Kinds: ``regex``
(occurs anywhere), ``substring``, ``word`` (occurs as a whole word), ``every`` (each bare word of the message is a pattern of
this kind of the same priority). Rules are few and go to the tasks with the function; their number is checked.

Defined cases: a null or blank message, and one that no rule matches, get the default; of equal priorities the first in
the order of intent, kind and pattern decides; an empty table of rules gives the default to all.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, functions as F

from quern.functions import lexicons as lex
from quern.functions.text import SPACE, java, strip

SCHEMA = "priority int, intent string, kind string, pattern string, min_words int, max_words int"
KINDS = ("regex", "substring", "word", "every")
#: Rules that may be sent to the tasks.
MOST = 200_000
#: Marks at the ends of a word that don't count.
EDGES = ".,!؟?"
#: Lower-case characters that patterns match whatever the case, as the letters of literals.
SAME = {0x17F: "s", 0x1E9E: "ß"}


def default_rules() -> list[tuple]:
    """The rules of ``routing.intent``, in its order."""
    rows: list[tuple] = []
    plain = [("crisis", lex.CRISIS), ("offensive", lex.OFFENSIVE), ("language_switch", (*lex.SWITCH_TO_EN, *lex.SWITCH_TO_AR))]
    rows += [(i, name, "regex", p, None, None) for i, (name, patterns) in enumerate(plain, 1) for p in patterns]
    rows += [(4, "greeting", "word" if len(g) <= 4 else "substring", g, None, 4) for g in lex.GREETINGS]
    rows += [(5, "acknowledgment", "every", w, None, 6) for w in lex.ACKNOWLEDGMENTS]
    rows += [(6, "out_of_scope", "regex", p, None, None) for p in lex.OUT_OF_SCOPE]
    rows += [(7, "in_scope", "substring", k, None, None) for k in (*lex.KEYWORDS_AR, *(x.lower() for x in lex.KEYWORDS_EN))]
    rows += [(7, "in_scope", "regex", p, None, None) for p in lex.QUESTIONS]
    return [*rows, (8, "in_scope", "regex", "(?:[؀-ۿ][^؀-ۿ]*){4}", 2, None)]


def literals_of(pattern: str) -> set[str] | None:
    """Lower-case texts of which each match of a pattern holds at least one; None where there is no such set."""
    return _literals(re._parser.parse(pattern))  # the parse tree has no public form


def _literals(tree) -> set[str] | None:
    """Of a sequence, the set whose shortest text is longest, among runs of characters, groups and alternatives."""
    found: list[set[str]] = []
    run = ""

    def close() -> None:
        nonlocal run
        if run:
            found.append({run.lower()})
        run = ""

    for op, value in tree:
        name = str(op)
        if name == "LITERAL":
            run += chr(value)
            continue
        close()
        inner = None
        if name == "SUBPATTERN":
            inner = _literals(value[-1])
        elif name == "BRANCH":
            sets = [_literals(branch) for branch in value[1]]
            inner = None if any(s is None for s in sets) else set().union(*sets)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
            inner = _literals(value[2])
        elif name == "IN" and all(str(kind) == "LITERAL" for kind, _ in value):
            inner = {chr(c).lower() for _, c in value}
        if inner:
            found.append(inner)
    close()
    return max(found, key=lambda s: min(map(len, s)), default=None)


class Rules:
    """Rules made ready: built once in a Python worker, from rows of SCHEMA."""

    def __init__(self, rows: list[tuple], default: str):
        self.rows = sorted(map(tuple, rows), key=lambda r: r[:4])
        self.default = default
        odd = {r[2] for r in self.rows} - set(KINDS)
        if odd:
            raise ValueError(f"unknown kinds of rules: {sorted(odd)}")

    @cached_property
    def pattern(self) -> dict[int, regex.Pattern]:
        whole = {"regex": java, "word": lambda p: java(rf"\b{regex.escape(p)}\b")}
        return {i: regex.compile(whole[kind](p), regex.IGNORECASE) for i, (_, _, kind, p, *_) in enumerate(self.rows) if kind in whole}

    @cached_property
    def every(self) -> dict[int, set[str]]:
        """The words of each priority's rules of that kind, by the number of the first of them."""
        first: dict[int, int] = {}
        words: dict[int, set[str]] = defaultdict(set)
        for i, (priority, _, kind, p, *_) in enumerate(self.rows):
            if kind == "every":
                words[first.setdefault(priority, i)].add(p)
        return words

    @cached_property
    def automaton(self) -> tuple[ahocorasick.Automaton | None, list[int]]:
        """The automaton, which gives the rules of a literal, and the rules that are always tried."""
        of: dict[str, list[int]] = defaultdict(list)
        always = list(self.every)
        for i, (_, _, kind, p, *_) in enumerate(self.rows):
            if kind == "every":
                continue
            needed = {p} if kind in ("substring", "word") else literals_of(p)
            for literal in needed or ():
                of[literal].append(i)
            if not needed:
                always.append(i)
        found = ahocorasick.Automaton()
        for literal, rules in of.items():
            found.add_word(literal, rules)
        if of:
            found.make_automaton()
        return found if of else None, always

    def intent(self, text: str | None) -> str:
        """The intent of a trimmed message in lower case."""
        if not text:
            return self.default
        automaton, always = self.automaton
        able = set(always)
        for _, rules in automaton.iter(text.translate(SAME)) if automaton else ():
            able.update(rules)
        words = [w for w in WORDS.split(text) if w]
        for i in sorted(able):
            _, intent, kind, _, least, most = self.rows[i]
            if (least is None or len(words) >= least) and (most is None or len(words) <= most) and self._holds(i, kind, text, words):
                return intent
        return self.default

    def _holds(self, i: int, kind: str, text: str, words: list[str]) -> bool:
        if kind == "substring":
            return True  # the automaton met it
        if kind == "every":
            bare = [b for w in words if len(b := w.strip(EDGES)) > 1]
            return bool(bare) and all(b in self.every[i] for b in bare)
        return self.pattern[i].search(text) is not None


WORDS = regex.compile(f"[{SPACE}]+")


def route(messages: DataFrame, rules: DataFrame, text: Column | str = "text", name: str = "intent", default: str = "out_of_scope") -> DataFrame:
    """``messages`` with the intent of each by the table of rules (SCHEMA)."""
    rows = [tuple(r) for r in rules.select("priority", "intent", "kind", "pattern", "min_words", "max_words").limit(MOST + 1).collect()]
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} rules")
    ready = Rules(rows, default)

    @F.pandas_udf("string")
    def decide(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in parts:
            yield some.map(ready.intent, na_action=None)

    return messages.withColumn(name, decide(strip(F.lower(F.col(text) if isinstance(text, str) else text))))
