"""Command lines: what arguments a command takes, and how a line of text or JSON is read.

A command declares its arguments as typed values; their places, defaults and the help text all come from that.
A line is read from left to right by a scanner: [variable =] name [(arguments)], arguments divided by commas or blanks,
each with or without its name.
"""

from __future__ import annotations

import json
from dataclasses import dataclass


@dataclass(frozen=True)
class Arg:
    """An argument: `kind` says what it holds, `given` whether it must be there, `default` what holds if it is not."""

    name: str
    kind: str
    given: bool = True
    default: object = None
    options: tuple[str, ...] = ()

    def described(self) -> str:
        what = self.kind + (f" ({' | '.join(self.options)})" if self.options else "")
        if self.given:
            return f"{self.name}: {what}"
        shown = {True: "true", False: "false", None: "none", "\t": "tab"}.get(self.default, self.default)
        return f"{self.name}: {what}, if left out {shown}"


def needs(name: str, kind: str = "text", *options: str) -> Arg:
    return Arg(name, kind, True, None, options)


def takes(name: str, kind: str = "text", default: object = None, *options: str) -> Arg:
    return Arg(name, kind, False, default, options)


def flag(name: str, default: bool = False) -> Arg:
    return Arg(name, "true or false", False, default)


@dataclass
class Command:
    """A parsed line: optional variable, name, and arguments (unnamed ones as arg0, arg1, ... by their place)."""

    name: str
    args: dict[str, str]
    assign: str | None = None


class Unreadable(Exception):
    """The line is no command."""


class Scanner:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    @property
    def ahead(self) -> str:
        """The next character, nothing at the end."""
        return self.text[self.at : self.at + 1]

    def skip(self, signs: str = "") -> None:
        while self.ahead and (self.ahead.isspace() or self.ahead in signs):
            self.at += 1

    def run_of(self, wanted) -> str:
        start = self.at
        while self.ahead and wanted(self.ahead):
            self.at += 1
        return self.text[start : self.at]

    def name(self) -> str:
        found = self.run_of(lambda c: c == "_" or c.isalnum())
        if not found[:1].isalpha() or not found.isascii():
            raise Unreadable(found)
        return found

    def key(self) -> str | None:
        """The name before an equals sign, if the argument has one."""
        start = self.at
        found = self.run_of(lambda c: c.isascii() and c.isalnum())
        self.skip()
        if found and self.ahead == "=":
            self.at += 1
            self.skip()
            return found.lower()
        self.at = start
        return None

    def value(self) -> str:
        quote = self.ahead
        if quote in ("'", '"'):
            close = self.text.find(quote, self.at + 1)
            if close < 0:
                raise Unreadable(self.text)
            found, self.at = self.text[self.at + 1 : close], close + 1
            return found
        return self.run_of(lambda c: c != "," and not c.isspace())

    def arguments(self) -> dict[str, str]:
        found: dict[str, str] = {}
        self.skip(",")
        while self.ahead:
            key = self.key()
            value = self.value()
            found[key or f"arg{len(found)}"] = value
            self.skip(",")
        return found


def parse_text(line: str) -> Command | None:
    """None if the line is no command."""
    scan, assign = Scanner(line.strip()), None
    try:
        name = scan.name()
        scan.skip()
        if scan.ahead == "=":
            assign, scan.at = name, scan.at + 1
            scan.skip()
            name = scan.name()
            scan.skip()
        if not scan.ahead:
            return Command(name.lower(), {}, assign)
        if scan.ahead != "(" or not scan.text.endswith(")"):
            return None
        return Command(name.lower(), Scanner(scan.text[scan.at + 1 : -1]).arguments(), assign)
    except Unreadable:
        return None


def parse_json(line: str) -> Command | None:
    try:
        data = json.loads(line)
        args = data.get("args") or {}
        if not isinstance(data["command"], str) or any(not isinstance(v, str) for v in args.values()):
            return None
        return Command(data["command"].lower(), {k.lower(): v for k, v in args.items()}, data.get("assign"))
    except (ValueError, KeyError, AttributeError, TypeError):
        return None
