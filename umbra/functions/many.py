"""Many patterns over one text: an automaton over their required literals names those worth trying.

A pattern that matches holds some text of a set that can be told from it: one literal,
or one of several where it has alternatives.  The literals of all patterns stand in one
automaton (its goto and fail tables are built once a worker), which reads a text's bytes
once, in lower case.  Only patterns whose literal it meets are tried, and those that
have none.  So the cost hardly grows with the number of patterns, and the answer is that
of trying them all.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from umbra.functions.dialect import Pattern

#: Up to so many patterns are searched by the engine, one after another.
FEW = 24
#: Shorter literals are met in every text: they are looked for by themselves.
SHORT = 3


def many(patterns: tuple) -> bool:
    return len(patterns) > FEW


def _better(a: frozenset[bytes] | None, b: frozenset[bytes] | None) -> frozenset[bytes] | None:
    """Of two sets that hold for a pattern the one that is met less often: longer texts, then fewer."""
    if a is None or b is None:
        return b if a is None else a
    return max(a, b, key=lambda s: (min(map(len, s)), -len(s)))


def _required(tree, names, spell) -> frozenset[bytes] | None:
    """Texts of which any match of a parsed sequence holds one; None if that can't be told."""
    best, run = None, b""

    def ended(run: bytes) -> frozenset[bytes] | None:
        return _better(best, frozenset([run])) if run else best

    for op, argument in tree:
        if op is names.LITERAL:
            run += spell(argument)
            best = ended(run)
        elif op in (names.AT, names.ASSERT, names.ASSERT_NOT):
            continue  # takes nothing, so what stands around it touches
        elif op is names.SUBPATTERN:
            best, run = _better(best, _required(argument[3], names, spell)), b""
        elif op is names.ATOMIC_GROUP:
            best, run = _better(best, _required(argument, names, spell)), b""
        elif op is names.BRANCH:
            each = [_required(b, names, spell) for b in argument[1]]
            best, run = _better(best, None if None in each else frozenset().union(*each)), b""
        elif op in (names.MAX_REPEAT, names.MIN_REPEAT, names.POSSESSIVE_REPEAT) and argument[0] > 0:
            if len(argument[2]) == 1 and argument[2][0][0] is names.LITERAL:  # its first round touches the run
                best = ended(run + spell(argument[2][0][1]))
            best, run = _better(best, _required(argument[2], names, spell)), b""
        else:
            run = b""
    return best


@lru_cache(maxsize=4096)
def required(pattern: Pattern) -> frozenset[bytes] | None:
    """Lower-case bytes of which a text that the pattern is in has one, in lower case; None if that can't be told."""
    try:
        from re import _constants, _parser
    except ImportError:  # another Python: each pattern is tried
        return None
    compiled = pattern.compiled()
    if pattern.unicode and ("i" in pattern.flags or "(?" in pattern.body and "i" in pattern.body):
        return None  # beyond ASCII two spellings of a letter have other bytes
    spell = (lambda n: chr(n).encode("utf-8", "surrogatepass").lower()) if pattern.unicode else (lambda n: bytes([n]).lower())
    return _required(_parser.parse(compiled.pattern, compiled.flags), _constants, spell)


class Searcher:
    """Is any of the patterns in a text?  Built once a worker (``searcher``)."""

    def __init__(self, patterns: tuple[Pattern, ...]):
        import ahocorasick

        self.always: list[Pattern] = []
        short: dict[bytes, list[Pattern]] = {}
        listed: dict[bytes, list[Pattern]] = {}
        for pattern in dict.fromkeys(patterns):
            literals = required(pattern)
            if literals is None:
                self.always.append(pattern)
                continue
            into = short if min(map(len, literals)) < SHORT else listed
            for text in literals:
                into.setdefault(text, []).append(pattern)
        self.short = list(short.items())
        self.automaton = ahocorasick.Automaton()
        for text, wanted in listed.items():
            self.automaton.add_word(text.decode("latin-1"), wanted)
        self.automaton.make_automaton()
        self.listed = bool(listed)

    def candidates(self, raw: bytes):
        """The patterns worth trying, some of them more than once."""
        low = raw.lower()  # of bytes: ASCII only
        if self.listed:
            for _, wanted in self.automaton.iter(low.decode("latin-1")):
                yield from wanted
        for text, wanted in self.short:
            if text in low:
                yield from wanted
        yield from self.always

    def found_in(self, raw: bytes) -> bool:
        tried = set()
        for pattern in self.candidates(raw):
            if id(pattern) not in tried:
                tried.add(id(pattern))
                if pattern.found_in(raw):
                    return True
        return False


@lru_cache(maxsize=16)
def searcher(patterns: tuple[Pattern, ...]) -> Searcher:
    return Searcher(patterns)


def any_found_udf(patterns: tuple[Pattern, ...]):
    """Over binary columns: is one of the patterns in it?"""

    @F.arrow_udf("boolean")
    def found(values):
        import pyarrow as pa

        look = searcher(patterns).found_in
        return pa.array([None if v is None else look(v) for v in (x.as_py() for x in values)], pa.bool_())

    return found
