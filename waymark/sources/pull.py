"""JSON documents read a value at a time, so that what is held is one element of a long list."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import TextIO

#: Characters that are read at once, at least.
CHUNK = 1 << 20


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON number")


_DECODER = json.JSONDecoder(parse_constant=_no_constant)


class Pull:
    """A cursor in a stream of JSON text.

    A value that isn't whole yet makes the buffer twice as long, so a value is
    decoded twice on average, and the buffer is bounded by the longest value.
    """

    def __init__(self, stream: TextIO):
        self.stream, self.text, self.at, self.ended = stream, "", 0, False

    def more(self) -> bool:
        """Reads on, dropping what was consumed; False at the end of the stream."""
        if self.ended:
            return False
        rest = self.text[self.at :]
        new = self.stream.read(max(CHUNK, len(rest)))
        self.text, self.at, self.ended = rest + new, 0, not new
        return bool(new)

    def peek(self) -> str:
        """The next character that is no white space; empty at the end."""
        while True:
            while self.at < len(self.text) and self.text[self.at] in " \t\n\r":
                self.at += 1
            if self.at < len(self.text) or not self.more():
                return self.text[self.at : self.at + 1]

    def take(self, wanted: str) -> None:
        if self.peek() != wanted:
            raise ValueError(f"JSON: {wanted!r} expected, {self.peek()!r} found")
        self.at += 1

    def value(self):
        """The next value, whole."""
        self.peek()
        while True:
            try:
                out, end = _DECODER.raw_decode(self.text, self.at)
            except json.JSONDecodeError:
                if not self.more():
                    raise
                continue
            if end + 2 >= len(self.text) and not self.ended:  # a number may go on, behind a point or an e+ too
                self.more()
                continue
            self.at = end
            return out

    def members(self) -> Iterator[str]:
        """The keys of an object; the caller takes each value before it goes on."""
        self.take("{")
        first = True
        while self.peek() != "}":
            if not first:
                self.take(",")
            first = False
            if self.peek() != '"':
                raise ValueError("JSON: a key expected")
            name = self.value()
            self.take(":")
            yield name
        self.take("}")

    def elements(self, take: Callable | None = None) -> Iterator:
        """The elements of a list, each decoded when it is asked for; null is a list without any."""
        if self.peek() == "n" and self.value() is None:
            return
        self.take("[")
        first = True
        while self.peek() != "]":
            if not first:
                self.take(",")
            first = False
            yield self.value() if take is None else take()
        self.take("]")

    def skip(self) -> None:
        """Passes over a value; lists and objects are never held whole."""
        if self.peek() == "[":
            for _ in self.elements(self.skip):
                pass
        elif self.peek() == "{":
            for _ in self.members():
                self.skip()
        else:
            self.value()

    def end(self) -> None:
        if self.peek():
            raise ValueError("JSON: more after the document")
