"""Splitting text for byte-level BPE, and a bounded cache of what each chunk of text encodes to."""

from __future__ import annotations

import re

import regex

#: Texts made of these characters alone: there Python's re classes and the pattern's Unicode classes agree.
_OUTSIDE = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‧‰-⁞]")
#: Spaces that touch other white space, of that which _OUTSIDE lets pass; without one, single spaces alone part the chunks.
_TOUCHING = ("  ", *(x for w in "\t\n\v\f\r\x85\xa0" for x in (f"{w} ", f" {w}")))
#: The pattern never joins what stands before a lone space with what follows it.
_LONE_SPACE = regex.compile(r"(?<=\S) (?=\S)")


def chunks(text: str) -> tuple[str, list[str]]:
    """The parts of text that encode independently of each other: the first, and those that each follow a space, without it.

    The pattern's pieces hold a space only in front or in runs of white space, so a lone space
    between two other characters always starts a piece.
    """
    first, *rest = _LONE_SPACE.split(text) if _OUTSIDE.search(text) or any(x in text for x in _TOUCHING) else text.split(" ")
    return first, rest


class Splitter:
    """All pieces of the pattern in a text, by Python's re where its classes agree, else by the pattern itself."""

    def __init__(self, pattern: str):
        self.exact = regex.compile(pattern)
        fast = pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")
        self.fast = re.compile(fast) if r"\p" not in fast else None

    def __call__(self, text: str) -> list[str]:
        if self.fast is None or _OUTSIDE.search(text):
            return self.exact.findall(text)
        return self.fast.findall(text)


class Bounded(dict):
    """A dictionary that computes what it lacks, and starts anew beyond a number of entries; long keys aren't kept."""

    def __init__(self, compute, most: int, longest: int = 64):
        super().__init__()
        self.compute, self.most, self.longest = compute, most, longest

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value
