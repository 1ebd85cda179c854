"""Delimited byte-mode patterns (``/…/i``) for Java's and Python's regex engines.

Without the flag ``u`` a pattern means bytes: word characters, boundaries and case are
ASCII, ``.`` and classes take one byte.  ``$`` also stands before a last line feed and
``.`` stops at line feeds only.  Each pattern is spelled anew for both engines with all
of that written out; named groups become numbers, quotes and comments go, inline flags
get a scope.  A pattern that reads a character beyond ASCII byte by byte (``bytewise``)
is searched in Java in a view of the text with one character a byte.

A pattern that isn't valid is None, with a warning; a valid one that an engine here
can't express (``Unsupported``) raises: a rule never goes missing silently.

Java's engine recurses once for every round of a repeated group, and a long text
overflows its stack.  Groups that can be repeated without ever giving back what they
took are made possessive, which Java does in a loop; a pattern with another unbounded
group is ``deep`` and searched by Python instead (see ``search``).
"""

from __future__ import annotations

import re
import sys
import unicodedata
import warnings
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_WORD = "[0-9A-Za-z_]"
_CLOSERS = {"(": ")", "[": "]", "{": "}", "<": ">"}
_KNOWN_FLAGS = "imsxuUDASXJn"
# The members of named classes.
_POSIX = {
    "alpha": "A-Za-z",
    "digit": "0-9",
    "alnum": "0-9A-Za-z",
    "upper": "A-Z",
    "lower": "a-z",
    "word": "0-9A-Za-z_",
    "xdigit": "0-9A-Fa-f",
    "blank": " \\t",
    "space": " \\t-\\r",
    "punct": "!-\\/:-@\\[-`{-~",
    "print": " -~",
    "graph": "!-~",
    "cntrl": "\\x00-\\x1f\\x7f",
    "ascii": "\\x00-\\x7f",
}
_SETS = {"d": "0-9", "w": "0-9A-Za-z_", "s": " \\t-\\r", "h": "\\t \\xa0", "v": "\\n-\\r\\x85"}
_CONTROLS = {"a": 7, "e": 27, "f": 12, "n": 10, "r": 13, "t": 9}
#: Valid elsewhere, but beyond one of the engines here.
_BEYOND = re.compile(r"\(\?(?:\(|R|[+-]?\d|&|P>|C|\||\^)|\(\*|\\[KXCG]")


class Unsupported(ValueError):
    """A valid pattern that can't be expressed here."""


class _Invalid(ValueError):
    pass


def _char(n: int) -> str:
    """A character by number, spelled so that it is a literal for both engines, in and out of classes."""
    c = chr(n)
    if c.isascii() and (c.isalnum() or c in "_ @:/,;=~`'\"<>%!"):
        return c
    return f"\\x{n:02x}" if n < 256 else c


@lru_cache(maxsize=64)
def _property(name: str, top: int) -> str:
    """The members of a general category up to ``top``, as ranges."""
    name = name.removeprefix("^")
    if name == "Any":
        return f"\\x00-{_char(top)}"
    wanted = {"L&": ("Lu", "Ll", "Lt")}.get(name, (name,))
    if not all(re.fullmatch(r"[CLMNPSZ][a-z]?", w) for w in wanted):
        raise Unsupported(f"property {name}")
    return _ranges([i for i in range(top + 1) if not 0xD800 <= i < 0xE000 and unicodedata.category(chr(i)).startswith(wanted)])


def _ranges(numbers: list[int]) -> str:
    out, i = [], 0
    while i < len(numbers):
        j = i
        while j + 1 < len(numbers) and numbers[j + 1] == numbers[j] + 1:
            j += 1
        out.append(_char(numbers[i]) + (f"-{_char(numbers[j])}" if j > i else ""))
        i = j + 1
    return "".join(out)


def _outside(members: str) -> str:
    """The other bytes."""
    inside = re.compile(f"[{members}]".encode("latin-1"))
    return _ranges([b for b in range(256) if not inside.match(bytes([b]))])


@dataclass
class _Atom:
    """One piece of a pattern: its text, and what it is."""

    text: str
    #: literal, set, wide (any byte beyond ASCII), high (some of them), open, look, close, bar, boundary or mark
    kind: str
    members: str = ""
    quantifier: str = ""

    @property
    def least(self) -> int:
        q = self.quantifier
        return 0 if q[:1] in ("*", "?") else int(re.match(r"\{(\d+)", q)[1]) if q[:1] == "{" else 1


@dataclass
class _Scope:
    flags: str
    opened: list[str] = field(default_factory=list)  # scopes of inline flags to be closed with the group


class _Reader:
    """A pattern's body as atoms.  ``units``: ``bytes`` one a byte, ``text`` characters as they are."""

    def __init__(self, body: str, flags: str, units: str):
        self.body, self.flags, self.units = body, flags, units
        self.unicode = "u" in flags
        self.atoms: list[_Atom] = []
        self.at = 0
        self.names, self.groups = self._named()
        self.scopes = [_Scope("".join(f for f in "imsx" if f in flags))]

    def _named(self) -> tuple[dict[str, int], int]:
        names, n, i, inside = {}, 0, 0, False
        while i < len(self.body):
            if self.body.startswith("\\Q", i):
                end = self.body.find("\\E", i + 2)
                i = len(self.body) if end < 0 else end + 2
                continue
            c = self.body[i]
            if c == "\\":
                i += 2
                continue
            if inside:
                inside = c != "]"
            elif c == "[":
                inside = True
                i += len(re.match(r"\[\^?\]?", self.body[i:])[0]) - 1
            elif c == "(" and (m := re.match(r"\((?:(?!\?)|\?(?:P?<(?![=!])([^>]+)>|'([^']+)'))", self.body[i:])) and not ("n" in self.flags and not (m[1] or m[2])):
                n += 1
                if m[1] or m[2]:
                    names.setdefault(m[1] or m[2], n)
            i += 1
        return names, n

    @property
    def scope(self) -> _Scope:
        return self.scopes[-1]

    def add(self, text: str, kind: str, members: str = "") -> None:
        self.atoms.append(_Atom(text, kind, members))

    def literal(self, n: int) -> None:
        if n > 127 and not self.unicode and self.units == "bytes":
            for b in chr(n).encode("utf-8", "surrogatepass"):
                self.add(_char(b), "literal")
        else:
            self.add(_char(n), "literal", "wide" if n > 127 else "")

    def byte(self, n: int) -> None:
        """A number: a byte as such, a character with ``u``."""
        if n > 255 and not self.unicode:
            raise _Invalid("a number beyond a byte")
        self.add(_char(n), "high" if n > 127 and not self.unicode else "literal")

    def members(self, text: str, negated: bool = False) -> None:
        self._set(text, negated)

    def _set(self, text: str, negated: bool) -> None:
        high = not self.unicode and re.search(r"\\x[89a-f]|[^\x00-\x7f]", text) is not None
        if self.units == "bytes" and not self.unicode:  # a character beyond ASCII is its bytes, each a member
            text = re.sub(r"[^\x00-\x7f]", lambda m: "".join(_char(b) for b in m[0].encode("utf-8", "surrogatepass")), text)
        self.add(f"[{'^' if negated else ''}{text}]", "high" if high else "wide" if negated and not self.unicode else "set", "" if negated else text)

    def read(self) -> list[_Atom]:
        while self.at < len(self.body):
            self._one()
        if len(self.scopes) != 1:
            raise _Invalid("a group isn't closed")
        self.add("".join(")" for _ in self.scope.opened), "mark")
        return self.atoms

    def _take(self, pattern: str) -> re.Match[str] | None:
        m = re.compile(pattern, re.S).match(self.body, self.at)
        if m:
            self.at = m.end()
        return m

    def _one(self) -> None:
        flags = self.scope.flags
        if "x" in flags and self._take(r"\s+|#[^\n]*"):
            return
        if m := self._take(r"\\Q(.*?)(?:\\E|$)"):
            for c in m[1]:
                self.literal(ord(c))
        elif self._take(r"\\E|\(\?#[^)]*\)"):
            pass
        elif m := self._take(r"\(\?P=(\w+)\)"):
            self._reference(m[1])
        elif m := self._take(r"\(\?([imsxJUn]*)(?:-([imsxJUn]*))?([:)])"):
            self._flags(m)
        elif m := self._take(r"\((?:\?(?:<?[=!]|>))"):
            self.scopes.append(_Scope(flags))
            self.add(m[0], "look" if m[0] != "(?>" else "open")
        elif m := self._take(r"\((?:\?(?:P?<[A-Za-z_]\w*>|'[A-Za-z_]\w*'))?(?!\?)"):
            self.scopes.append(_Scope(flags))
            self.add("(?:" if "n" in self.flags and m[0] == "(" else "(", "open")
        elif self._take(r"\)"):
            closed = self.scopes.pop()
            if not self.scopes:
                raise _Invalid("a closing parenthesis too many")
            self.add(")" * (len(closed.opened) + 1), "close")
        elif self._take(r"\|"):
            self.add(")" * len(self.scope.opened) + "|" + "".join(self.scope.opened), "bar")
        elif self._take(r"\["):
            self._class()
        elif self._take(r"\."):
            self.add("[\\x00-\\U0010ffff]" if "s" in flags and self.unicode else "[\\x00-\\xff]" if "s" in flags and self.units == "bytes" else "[\\s\\S]" if "s" in flags else "[^\\n]", "set" if self.unicode else "wide")
        elif self._take(r"\^"):
            self.add("(?:\\A|(?<=\\n)(?=[\\s\\S]))" if "m" in flags else "\\A", "mark")
        elif self._take(r"\$"):
            self.add("(?=\\n|\\z)" if "m" in flags else "\\z" if "D" in self.flags else "(?=\\n?\\z)", "mark")
        elif self.atoms and (m := self._take(r"(?:[*+?]|\{\d+(?:,\d*)?\})[+?]?")):
            if self.atoms[-1].kind in ("bar", "look") or self.atoms[-1].quantifier or (self.atoms[-1].kind == "open"):
                raise _Invalid("nothing to repeat")
            self.atoms[-1].quantifier = m[0]
        elif m := self._take(r"\\"):
            self._escape()
        elif self._take(r"[*+?]"):
            raise _Invalid("nothing to repeat")
        else:
            self.literal(ord(self.body[self.at]))
            self.at += 1

    def _flags(self, m: re.Match[str]) -> None:
        on, off = (set(x or "") for x in (m[1], m[2]))
        flags = "".join(f for f in "imsx" if (f in self.scope.flags or f in on) and f not in off)
        fold = "(?i:" if "i" in flags and "i" not in self.scope.flags else "(?-i:" if "i" not in flags and "i" in self.scope.flags else None
        if m[3] == ":":
            self.scopes.append(_Scope(flags))
            self.add(fold or "(?:", "open")
        else:
            if fold:
                self.scope.opened.append(fold)
                self.add(fold, "mark")
            self.scope.flags = flags

    def _escape(self) -> None:
        if m := self._take(r"x\{([0-9A-Fa-f]+)\}|x([0-9A-Fa-f]{0,2})|o\{([0-7]+)\}|0([0-7]{0,2})"):
            self.byte(int(m[1] or m[2] or "0", 16) if m[3] is None and m[4] is None else int(m[3] or m[4] or "0", 8))
        elif m := self._take(r"(?:k|g)(?:\{(-?\w+)\}|<(\w+)>|'(\w+)')|g(-?\d+)|([1-9]\d*)"):
            self._reference(next(x for x in m.groups() if x is not None))
        elif m := self._take(r"([pP])(?:\{(\^?[A-Za-z&]+)\}|([A-Z]))"):
            name = m[2] or m[3]
            self.members(_property(name, sys.maxunicode if self.unicode else 255), (m[1] == "P") != name.startswith("^"))
        elif m := self._take(r"[dwshv]"):
            self.add("\\" + m[0], "set", _SETS[m[0]]) if self.unicode and m[0] in "dws" else self.members(_SETS[m[0]])
        elif m := self._take(r"[DWSHV]"):
            self.add("\\" + m[0], "set") if self.unicode and m[0] in "DWS" else self.members(_SETS[m[0].lower()], True)
        elif self._take("R"):
            self.add("(?>\\r\\n|[\\n-\\r\\x85])", "high")
        elif self._take("N"):
            self.add("[^\\n]", "set" if self.unicode else "wide")
        elif m := self._take("[bB]"):
            self.add(m[0], "boundary")
        elif m := self._take("[AzZ]"):
            self.add({"Z": "(?=\\n?\\z)"}.get(m[0], "\\" + m[0]), "mark")
        elif m := self._take("c(.)"):
            self.literal(ord(m[1].upper()) ^ 64)
        elif m := self._take("[aefnrt]"):
            self.literal(_CONTROLS[m[0]])
        elif self._take("[A-Za-z]") or self.at >= len(self.body):
            raise _Invalid("an escape that means nothing")
        else:
            self.literal(ord(self.body[self.at]))
            self.at += 1

    def _reference(self, name: str) -> None:
        n = self.names.get(name)
        if n is None and re.fullmatch(r"-?\d+", name):
            so_far = sum(a.text == "(" for a in self.atoms)
            n = int(name) if int(name) > 0 else so_far + 1 + int(name)
        if n is None or not 0 < n <= self.groups:
            raise _Invalid("a reference to no group")
        self.add(f"(?:\\{n})", "set")

    def _class(self) -> None:
        negated, out, first = bool(self._take(r"\^")), [], True
        while first or not self._take(r"\]"):
            if self.at >= len(self.body):
                raise _Invalid("a class isn't closed")
            text, open_end = self._member()
            if open_end and self.body[self.at : self.at + 1] == "-" and self.body[self.at + 1 : self.at + 2] not in ("]", ""):
                back = self.at
                self.at += 1
                high, closed = self._member()
                if closed:
                    text += "-" + high
                else:  # a set can't end a range: the mark is a member
                    self.at = back + 1
                    text += "\\-"
            out.append(text)
            first = False
        self._set("".join(out), negated)

    def _member(self) -> tuple[str, bool]:
        """(a member of a class, is it a single character)."""
        if m := self._take(r"\[:(\^?)(\w+):\]"):
            if m[2] not in _POSIX:
                raise _Invalid("an unknown class")
            return (_outside(_POSIX[m[2]]) if m[1] else _POSIX[m[2]]), False
        if m := self._take(r"\\Q(.*?)(?:\\E|$)"):
            return "".join(_char(ord(c)) if ord(c) < 128 else c for c in m[1]), False
        if self._take(r"\\"):
            if m := self._take(r"x\{([0-9A-Fa-f]+)\}|x([0-9A-Fa-f]{0,2})|([0-7]{1,3})"):
                n = int(m[3], 8) if m[3] else int(m[1] or m[2] or "0", 16)
                if n > 255 and not self.unicode:
                    raise _Invalid("a number beyond a byte")
                return _char(n), True
            if m := self._take(r"([pP])(?:\{(\^?[A-Za-z&]+)\}|([A-Z]))"):
                name = m[2] or m[3]
                inside = _property(name, sys.maxunicode if self.unicode else 255)
                if (m[1] == "P") == name.startswith("^"):
                    return inside, False
                if self.unicode:
                    raise Unsupported("a negated property in a class")
                return _outside(inside), False
            if m := self._take(r"[dwshv]"):
                return ("\\" + m[0] if self.unicode and m[0] in "dws" else _SETS[m[0]]), False
            if m := self._take(r"[DWSHV]"):
                return ("\\" + m[0] if self.unicode and m[0] in "DWS" else _outside(_SETS[m[0].lower()])), False
            if m := self._take("[aefnrt]"):
                return _char(_CONTROLS[m[0]]), True
            if self._take("b"):
                return "\\x08", True
            if self._take("c(.)"):
                return _char(ord(self.body[self.at - 1].upper()) ^ 64), True
            if self._take("[A-Za-z]") or self.at >= len(self.body):
                raise _Invalid("an escape that means nothing")
        c = self.body[self.at]
        self.at += 1
        return (_char(ord(c)) if ord(c) < 128 else c), True


@dataclass(frozen=True)
class Pattern:
    body: str
    flags: str

    @property
    def unicode(self) -> bool:
        return "u" in self.flags

    @cached_property
    def _atoms(self) -> list[_Atom]:
        return _Reader(self._looped(), self.flags, "text").read()

    @cached_property
    def bytewise(self) -> bool:
        """Does it read characters beyond ASCII byte by byte, in a way that shows?"""
        return not self.unicode and any(a.kind == "high" or a.kind == "wide" and a.quantifier[:1] not in ("*", "+") or a.members == "wide" and a.quantifier for a in self._atoms)

    @cached_property
    def needs(self) -> str:
        """A text that stands in every match, if one can be told."""
        if "i" in self.flags or any(a.kind == "bar" and not self._within_group(i) or a.text.startswith("(?i") for i, a in enumerate(self._atoms)):
            return ""
        runs, depth, run = [""], 0, ""
        for a in self._atoms:
            depth += a.text.count("(") - a.text.count(")") if a.kind in ("open", "look", "close") else 0
            plain = a.kind == "literal" and not a.members and depth == 0
            if plain and not a.quantifier:
                run += _plain(a.text)
                runs.append(run)
            elif plain and a.least:
                runs.append(run + _plain(a.text))
                run = ""
            elif a.kind != "mark" and a.kind != "boundary":
                run = ""
        return max(runs, key=len)

    def _within_group(self, at: int) -> bool:
        depth = 0
        for a in self._atoms[:at]:
            depth += (a.kind in ("open", "look")) - (a.kind == "close")
        return depth > 0

    @cached_property
    def deep(self) -> bool:
        """Is a group repeated without bound, so that Java would recurse with the text's length?"""
        return any(a.kind == "close" and re.match(r"[*+]|\{\d+,\}", a.quantifier) and not a.quantifier.endswith("+", 1) for a in self._atoms)

    def _looped(self) -> str:
        """The body with a closing ``(A+B+…)*$`` made possessive.

        If no class shares a character with the one after it, the last with the first
        too, there is one way to take a run and what is given back never ends a line.
        """
        m = re.search(r"\((?:\?:)?((?:(?:\\[sdw]|\[(?:\\.|[^\]\\])+\])\+){2,})\)\*\$$", self.body)
        if m is None or set("mx") & set(self.flags):
            return self.body
        classes = re.findall(r"(\\[sdw]|\[(?:\\.|[^\]\\])+\])\+", m[1])
        case = re.IGNORECASE if "i" in self.flags else 0
        members = [{b for b in range(256) if re.match(c.encode(), bytes([b]), case)} for c in classes]
        if any(a & b for a, b in zip(members, members[1:] + members[:1])):
            return self.body
        return self.body[: m.start()] + "(?:" + "".join(f"{c}++" for c in classes) + ")*+$"

    def _spelled(self, units: str, java: bool) -> str:
        atoms = _Reader(self._looped(), self.flags, units).read()
        out = []
        for i, a in enumerate(atoms):
            text = a.text
            if a.kind == "boundary":
                text = "\\" + text if self.unicode or not java else _boundary(atoms, i)
            elif java and text.startswith("[") and len(text) > 2:
                text = text.replace("&", "\\&")
            elif not java:
                text = text.replace("\\z", "\\Z").replace("\\U0010ffff", chr(sys.maxunicode))
            elif java:
                text = text.replace("\\U0010ffff", "\\x{10ffff}")
            out.append(text + a.quantifier)
        body = "".join(out)
        lead = f"(?{'i' if 'i' in self.flags else ''}{'uU' if java and self.unicode else ''})".replace("(?)", "")
        return f"{lead}\\A(?:{body})" if "A" in self.flags else lead + body

    def java(self, view: bool = False) -> str:
        """For Java; ``view``: over a text with one character a byte."""
        return self._spelled("bytes" if view else "text", True)

    def python(self) -> bytes | str:
        text = self._spelled("bytes", False)
        return text if self.unicode else text.encode("latin-1")

    @lru_cache(maxsize=512)
    def compiled(self) -> re.Pattern:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", FutureWarning)
            return re.compile(self.python())

    def found_in(self, value: bytes) -> bool:
        if not self.unicode:
            return self.compiled().search(value) is not None
        try:
            return self.compiled().search(value.decode("utf-8")) is not None
        except UnicodeDecodeError:
            return False


def _plain(text: str) -> str:
    return chr(int(text[2:], 16)) if text.startswith("\\x") else text


def _boundary(atoms: list[_Atom], at: int) -> str:
    """A boundary for Java; beside an atom of word characters one side is enough."""
    if atoms[at].text == "B":
        return f"(?:(?<={_WORD})(?={_WORD})|(?<!{_WORD})(?!{_WORD}))"
    word = lambda a: (a.kind == "literal" and re.fullmatch(r"\w", a.text, re.A)) or (a.kind == "set" and a.members and re.fullmatch(r"(?:[0-9A-Za-z_]-[0-9A-Za-z_]|[0-9A-Za-z_])+", a.members))
    if not any(a.kind == "bar" for a in atoms):
        after = next((a for a in atoms[at + 1 :] if a.kind != "open"), None)
        opened = atoms[at + 1 : atoms.index(after, at + 1)] if after else []
        if after and word(after) and after.least and all(a.text in ("(", "(?:") for a in opened) and _all_once(atoms, at + 1, opened):
            return f"(?={after.text})(?<!{_WORD})"
        before = atoms[at - 1] if at else None
        if before and word(before) and before.least:
            return f"(?!{_WORD})"
    return f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def _all_once(atoms: list[_Atom], first: int, opened: list[_Atom]) -> bool:
    """Are the groups that open from ``first`` on passed at least once?"""
    depth, todo = 0, len(opened)
    for a in atoms[first:]:
        depth += a.kind in ("open", "look")
        if a.kind == "close":
            if depth <= todo:
                if not a.least:
                    return False
                todo -= 1
            depth -= 1
            if not depth:
                break
    return True


def parse(delimited: object) -> Pattern | None:
    """The pattern between delimiters; None, with a warning, if it is not valid.  ``Unsupported`` if it can't be expressed."""
    if not isinstance(delimited, str):
        return None
    text = delimited.lstrip()
    if not text or text[0].isalnum() or text[0] in "\\ " or ord(text[0]) > 127:
        return _refused(delimited, "no delimiter")
    opener, end = text[0], text.rfind(_CLOSERS.get(text[0], text[0]))
    if end < 1:
        return _refused(delimited, "no closing delimiter")
    body, flags = text[1:end], text[end + 1 :].strip()
    if any(f not in _KNOWN_FLAGS for f in flags):
        return _refused(delimited, "an unknown flag")
    if re.search(r"(?<!\\)(?:\\\\)*" + re.escape(opener), body) and opener not in _CLOSERS:
        return _refused(delimited, "text after the closing delimiter")
    found = Pattern(body, flags)
    bare = re.sub(r"\\Q.*?(?:\\E|$)|\\[^KXCG]|\[\^?\]?(?:\\.|[^\]\\])*\]", "", body, flags=re.S)
    if m := _BEYOND.search(bare):
        raise Unsupported(f"pattern {delimited!r} uses {m[0]!r}, which neither Java nor Python have")
    try:
        found.compiled()
    except Unsupported as e:
        raise Unsupported(f"pattern {delimited!r}: {e}") from None
    except re.error as e:
        if "look-behind" in str(e):
            raise Unsupported(f"pattern {delimited!r}: {e}") from None
        return _refused(delimited, str(e))
    except (_Invalid, OverflowError, RecursionError, UnicodeEncodeError) as e:
        return _refused(delimited, str(e))
    return found


def _refused(delimited: str, why: str) -> None:
    warnings.warn(f"pattern {delimited!r} is not valid and never matches: {why}", stacklevel=3)


@lru_cache(maxsize=1024)
def _checked(java: str) -> str:
    """The pattern, compiled by Java on the driver: what it refuses fails here by name and not in a task."""
    session = SparkSession.getActiveSession()
    if session is not None:
        try:
            session.sparkContext._jvm.java.util.regex.Pattern.compile(java)
        except Exception as e:
            raise Unsupported(f"Java can't read {java!r}: {str(e)[:300]}") from None
    return java


def search(value: Column, pattern: Pattern, charset: str = "UTF-8", nested: bool = False) -> Column:
    """Is the pattern somewhere in a string column?  ``nested``: inside a lambda, where only Java can look."""
    if nested or not pattern.deep:
        view = charset != "UTF-8" and not pattern.unicode
        seen = value
        if not view and pattern.bytewise:
            view, seen = True, F.decode(value.cast("binary"), "ISO-8859-1")
        found = seen.rlike(_checked(pattern.java(view)))
        return value.contains(pattern.needs) & found if pattern.needs else found

    @F.pandas_udf("boolean")
    def found(values):
        return values.map(lambda v: None if v is None else pattern.found_in(v))

    # Bytes, not text, go to Python: a text need not be valid.
    return found(value.cast("binary") if charset == "UTF-8" else F.encode(value, charset))
