"""Contract patterns are ECMAScript, without the u and v flags and with what browsers allow beyond the standard; Spark's are Java's.

A pattern is read by ECMAScript's grammar, which decides whether it is one, and written as a Java pattern on the way. Groups become plain numbered ones.
What Java can't say: a dot is one code point, not one UTF-16 unit; a back reference to a group that took no part fails instead of matching nothing;
repetitions without a bound in a look-behind have one of 65,535, and a repeated group there that holds repetitions or choices is refused.
"""

from __future__ import annotations

import re

from veritab.functions.text import BLANKS as _SPACE

_LINE_ENDS = r"\n\r\u2028\u2029"
_DOT, _ANY, _NONE = f"[^{_LINE_ENDS}]", r"[\s\S]", "(?!)"
_EDGE, _NO_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))", r"(?:(?<=\w)(?=\w)|(?<!\w)(?!\w))"
#: Escapes of single characters.
_CONTROLS = {"t": 9, "n": 10, "v": 11, "f": 12, "r": 13}
_BOUND = re.compile(r"\{([0-9]+)(,([0-9]*))?\}")
_GROUPS = re.compile(r"\\[\s\S]|\[(?:\\[\s\S]|[^\]\\])*\]|\((?:\?<(?![=!])|(?!\?))")
_NAMED = re.compile(r"\\[\s\S]|\[(?:\\[\s\S]|[^\]\\])*\]|\(\?<(?![=!])")
_MOST = (1 << 31) - 1


class InvalidPattern(ValueError):
    pass


def _char(code: int) -> str:
    """A character that means itself, in and outside of classes."""
    c = chr(code)
    if c.isascii():
        return c if c.isalnum() else f"\\x{code:02X}"
    return f"\\x{{{code:X}}}" if 0xD800 <= code < 0xE000 else c


class _Pattern:
    """Reads from ``at`` on. ``behind``: whether that is in a look-behind."""

    def __init__(self, text: str):
        self.text, self.at = text, 0
        heads = [m[0] for m in _GROUPS.finditer(text)]
        self.n_groups = sum(h.startswith("(") for h in heads)
        self.has_names = any(m[0].startswith("(") for m in _NAMED.finditer(text))
        self.opened, self.closed, self.names = 0, set(), {}
        self.flags, self.behind = {"m": False, "s": False}, False
        self.choices: list[list[int]] = []
        #: Names that are referred to; each must be a group's.
        self.later: list[str] = []

    def looking_at(self, s: str) -> bool:
        return self.text.startswith(s, self.at)

    def take(self, s: str) -> bool:
        found = self.looking_at(s)
        self.at += len(s) * found
        return found

    def next(self) -> str:
        if self.at >= len(self.text):
            raise InvalidPattern("\\ at end of pattern")
        self.at += 1
        return self.text[self.at - 1]

    def matched(self, pattern: str) -> re.Match | None:
        found = re.compile(pattern).match(self.text, self.at)
        if found:
            self.at = found.end()
        return found

    def disjunction(self) -> str:
        self.choices.append([self.at, 0])
        out = [self.alternative()]
        while self.take("|"):
            self.choices[-1][1] += 1
            out.append(self.alternative())
        self.choices.pop()
        return "|".join(out)

    def alternative(self) -> str:
        out = []
        while self.at < len(self.text) and self.text[self.at] not in "|)":
            out.append(self.term())
        return "".join(out)

    def term(self) -> str:
        atom, repeatable = self.atom()
        found = self.quantifier()
        if found is None:
            return atom
        if not repeatable:
            raise InvalidPattern("Nothing to repeat")
        if self.behind and found[0] != "?" and atom[0] == "(" and re.search(r"(?<!\\)[|}?*+]", atom.replace("(?", "")):
            raise InvalidPattern("Java has no repeated group with repetitions or choices of its own in a look-behind")
        return f"(?:{atom}){found}" if atom.startswith(("(?=", "(?!", "(?<")) else f"{atom}{found}" if atom else ""

    def quantifier(self) -> str | None:
        if self.at < len(self.text) and self.text[self.at] in "*+?":
            least, most = {"*": (0, None), "+": (1, None), "?": (0, 1)}[self.next()]
        elif found := _BOUND.match(self.text, self.at):
            self.at = found.end()
            least, most = int(found[1]), int(found[1]) if found[2] is None else int(found[3]) if found[3] else None
            if most is not None and most < least:
                raise InvalidPattern("numbers out of order in {} quantifier")
        else:
            return None
        if most is None and self.behind:
            most = least + 65535
        least, most = min(least, _MOST), None if most is None else min(most, _MOST)
        lazy = "?" if self.take("?") else ""
        short = {(0, None): "*", (1, None): "+", (0, 1): "?"}.get((least, most))
        return (short or f"{{{least},{'' if most is None else most}}}") + lazy

    def atom(self) -> tuple[str, bool]:
        """Java's form of an atom or assertion, and whether it may be repeated."""
        if _BOUND.match(self.text, self.at):
            raise InvalidPattern("Nothing to repeat")
        c = self.next()
        if c == "(":
            return self.group()
        if c == "[":
            return self.character_class(), True
        if c == "\\":
            return self.escape()
        if c in "*+?":
            raise InvalidPattern("Nothing to repeat")
        if c == "^":
            return (f"(?<=^|[{_LINE_ENDS}])" if self.flags["m"] else "^"), False
        if c == "$":
            return (f"(?=\\z|[{_LINE_ENDS}])" if self.flags["m"] else "\\z"), False
        if c == ".":
            return (_ANY if self.flags["s"] else _DOT), True
        return _char(ord(c)), True

    def group(self) -> tuple[str, bool]:
        behind, flags, number = self.behind, dict(self.flags), None
        repeatable = True
        if self.take("?"):
            if self.take(":"):
                head = "(?:"
            elif self.take("=") or self.take("!"):
                head = f"(?{self.text[self.at - 1]}"
            elif self.take("<=") or self.take("<!"):
                head, repeatable, self.behind = f"(?{self.text[self.at - 2 : self.at]}", False, True
            elif self.looking_at("<"):
                head, number = "(", self.named()
            elif (found := self.matched(r"([ims]*)(-[ims]*)?:")) and (found[1] or len(found[2] or "") > 1):
                head = self.modified(found[1], found[2] or "")
            else:
                raise InvalidPattern("Invalid group")
        else:
            head, number = "(", self.opened + 1
            self.opened = number
        body = self.disjunction()
        if not self.take(")"):
            raise InvalidPattern("Unterminated group")
        if number is not None:
            self.closed.add(number)
        self.behind, self.flags = behind, flags
        return f"{head}{body})", repeatable

    def named(self) -> int:
        found = self.matched(r"<([^>]*)>")
        name = re.sub(r"\\u\{?([0-9A-Fa-f]{4,6})\}?", lambda m: chr(int(m[1], 16)), found[1]) if found else ""
        if not name.replace("$", "_").isidentifier():
            raise InvalidPattern("Invalid capture group name")
        here = [tuple(x) for x in self.choices]
        for there, _ in self.names.get(name, []):
            if not any(a[0] == b[0] and a[1] != b[1] for a, b in zip(there, here)):
                raise InvalidPattern("Duplicate capture group name")
        self.opened += 1
        self.names.setdefault(name, []).append((here, self.opened))
        return self.opened

    def modified(self, on: str, off: str) -> str:
        if len(set(on + off[1:])) < len(on + off[1:]):
            raise InvalidPattern("Invalid group")
        self.flags |= dict.fromkeys(set(on) & {"m", "s"}, True) | dict.fromkeys(set(off) & {"m", "s"}, False)
        return "(?iu:" if "i" in on else "(?-i:" if "i" in off else "(?:"

    def escape(self) -> tuple[str, bool]:
        c = self.next()
        if c == "b":
            return _EDGE, False
        if c == "B":
            return _NO_EDGE, False
        if c == "k" and self.has_names:
            found = self.matched(r"<([^>]*)>")
            if not found:
                raise InvalidPattern("Invalid named reference")
            self.later.append(found[1])
            numbers = [n for _, n in self.names.get(found[1], []) if n in self.closed]
            return (f"(?:{'|'.join(f'{chr(92)}{n}' for n in numbers)})" if numbers else "(?:)"), True
        if c in "123456789":
            digits = c + self.matched("[0-9]*")[0]
            if int(digits) <= self.n_groups:  # what isn't closed yet has matched nothing
                return (f"(?:\\{digits})" if int(digits) in self.closed else "(?:)"), True
            self.at -= len(digits) - 1
        code = self.code(c)
        return (code if isinstance(code, str) else _char(code)), True

    def code(self, c: str) -> int | str:
        """What an escape stands for, in and outside of classes: a character, or a class in Java's form."""
        if c in "dDwW":
            return f"\\{c}"
        if c == "s":
            return f"[{_SPACE}]"
        if c == "S":
            return f"[^{_SPACE}]"
        if c in _CONTROLS:
            return _CONTROLS[c]
        if c == "c":
            if found := self.matched("[A-Za-z]"):
                return ord(found[0]) % 32
            self.at -= 1
            return ord("\\")
        if c in "01234567":
            self.at -= 1
            return int(self.matched("[0-3][0-7]{0,2}|[4-7][0-7]?")[0], 8)
        if c in "xu":
            found = self.matched("[0-9A-Fa-f]{2}" if c == "x" else "[0-9A-Fa-f]{4}")
            if found:
                code = int(found[0], 16)
                low = re.compile(r"\\u([dD][c-fC-F][0-9A-Fa-f]{2})").match(self.text, self.at) if 0xD800 <= code < 0xDC00 else None
                if low:  # a pair of surrogates is one character to Java
                    self.at = low.end()
                    code = 0x10000 + (code - 0xD800 << 10) + int(low[1], 16) - 0xDC00
                return code
        return ord(c)

    def class_atom(self) -> int | str:
        c = self.next()
        if c != "\\":
            return ord(c)
        c = self.next()
        if c == "b":
            return 8
        if c == "c" and (found := self.matched("[0-9_]")):
            return ord(found[0]) % 32
        return self.code(c)

    def character_class(self) -> str:
        negated, items, others = self.take("^"), [], []

        def add(atom: int | str) -> None:
            if isinstance(atom, int):
                items.append(_char(atom))
            elif atom.startswith("[^"):
                others.append(atom)
            else:
                items.append(atom[1:-1] if atom.startswith("[") else atom)

        while not self.take("]"):
            if self.at >= len(self.text):
                raise InvalidPattern("Unterminated character class")
            first = self.class_atom()
            if self.looking_at("-") and not self.looking_at("-]") and self.at + 1 < len(self.text):
                self.at += 1
                last = self.class_atom()
                if isinstance(first, int) and isinstance(last, int):
                    if last < first:
                        raise InvalidPattern("Range out of order in character class")
                    items.append(f"{_char(first)}-{_char(last)}")
                    continue
                add(first)
                add(ord("-"))
                first = last
            add(first)
        if not items and not others:
            return _ANY if negated else _NONE
        if not others:
            return f"[{'^' if negated else ''}{''.join(items)}]"
        either = "|".join(([f"[{''.join(items)}]"] if items else []) + others)
        return f"(?:(?!{either}){_ANY})" if negated else f"(?:{either})"


def to_java(pattern: str, ignore_case: bool = False) -> str:
    """A Java pattern that finds what the ECMAScript one finds; InvalidPattern if it isn't one."""
    read = _Pattern(pattern)
    java = read.disjunction()
    if read.at < len(pattern):
        raise InvalidPattern("Unmatched ')'")
    if unknown := [n for n in read.later if n not in read.names]:
        raise InvalidPattern(f"Invalid named capture referenced: {unknown[0]}")
    return f"(?iu){java}" if ignore_case else java
