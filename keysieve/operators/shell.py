"""Command lines as calls: one lexer for POSIX shells and PowerShell.

A script becomes a flat list of calls, those of substitutions and subshells included. Each word of a call
keeps two readings: its text once quotes are gone, and what of it the shell still replaces (nothing
inside single quotes).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

LEXEMES = re.compile(
    r"""
    (?P<single>'[^']*')
  | (?P<double>"(?:\\.|[^"\\])*")
  | (?P<escape>\\.)
  | (?P<nested>\$\(|`)
  | (?P<open>[({])
  | (?P<close>[)}])
  | (?P<end>[;&|\n]+)
  | (?P<input>(?<!\d)<(?!<))
  | (?P<output>>+)
  | (?P<space>[ \t\r]+)
  | (?P<plain>[^'"\\$`(){};&|<>\s]+|.)
    """,
    re.VERBOSE | re.DOTALL,
)
SUBSTITUTION = re.compile(r"\$\(((?:[^()]|\([^()]*\))*)\)|`([^`]*)`")


@dataclass
class Word:
    text: str = ""
    live: str = ""


@dataclass
class Call:
    """One simple command: its words, redirections among them as words of their own (`<`, `>`)."""

    words: list[Word] = field(default_factory=list)

    @property
    def texts(self) -> list[str]:
        return [w.text for w in self.words]

    @property
    def alone(self) -> list[str]:
        """The words before any redirection."""
        texts = self.texts
        return texts[: min((i for i, t in enumerate(texts) if t in ("<", ">", ">>")), default=len(texts))]


class Lexer:
    def __init__(self, script: str, powershell: bool = False):
        # A backslash belongs to a path in PowerShell and is an escape elsewhere.
        self.script = script.replace("\\", "/") if powershell else script
        self.powershell, self.calls = powershell, []
        self.call, self.word, self.depth = Call(), None, 0

    def add(self, text: str, live: str) -> None:
        self.word = self.word or Word()
        self.word.text += text
        self.word.live += live

    def end_word(self) -> None:
        if self.word is not None:
            self.call.words.append(self.word)
        self.word = None

    def end_call(self) -> None:
        self.end_word()
        if self.call.words:
            self.calls.append(self.call)
        self.call, self.depth = Call(), 0

    def on_single(self, text: str) -> None:
        self.add(text[1:-1], "")

    def on_double(self, text: str) -> None:
        inner = text[1:-1] if self.powershell else re.sub(r'\\(["\\$`])', r"\1", text[1:-1])
        for whole in SUBSTITUTION.finditer(inner):
            self.calls += parse(whole.group(1) or whole.group(2) or "", self.powershell)
        self.add(inner, inner)

    def on_escape(self, text: str) -> None:
        self.add(text[1], "")

    def on_open(self, text: str) -> None:
        # After a word's characters it belongs to a method call or a ${name}; elsewhere it opens a subshell or block.
        if self.word is not None:
            self.depth += 1
            self.add(text, text)
        else:
            self.end_call()

    def on_close(self, text: str) -> None:
        if self.depth:
            self.depth -= 1
            self.add(text, text)
        else:
            self.end_call()

    def on_redirection(self, text: str) -> None:
        self.end_word()
        self.call.words.append(Word(text, ""))

    def run(self) -> list[Call]:
        for found in LEXEMES.finditer(self.script):
            kind, text = found.lastgroup, found.group()
            if kind in ("single", "double", "escape", "open", "close"):
                getattr(self, f"on_{kind}")(text)
            elif kind in ("input", "output"):
                self.on_redirection(text)
            elif kind in ("nested", "end"):
                self.end_call()
            elif kind == "space":
                if not self.depth:
                    self.end_word()
                else:
                    self.add(" ", " ")
            else:
                self.add(text, text)
        self.end_call()
        return self.calls


def parse(script: str, powershell: bool = False) -> list[Call]:
    return Lexer(script, powershell).run()
