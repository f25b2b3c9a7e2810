"""Text of TeX sources, by a stack of tokens.

Groups, environments, user macros and math nest, so they are read with a stack and
not by patterns: an expanded macro's tokens go back on the stack in its place.
The work is linear in the source: expansions may push ``GROWTH`` tokens a source
token, and beyond that a macro (one that calls itself, say) is dropped.

Defined results: null stays null; commands that aren't known lose their name and
optional argument and keep what is in their braces; comments, math (unless
``math``), figures, tables, bibliographies and the arguments of references go;
without ``\\begin{document}`` the whole source is text; a missing brace, ``$`` or
``\\end`` ends with its paragraph or with the source.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

GROWTH = 16
_TOKEN = re.compile(r"\\[A-Za-z@]+\*?[ \t]*\n?[ \t]*|\\(?:.|\n)|%[^\n]*(?:\n[ \t]*)?|\n[ \t]*(?:\n[ \t]*)+|\$\$|[{}\[\]$~#^_&]|[^\\%{}\[\]$~#^_&\n]+|\n")
#: TeX's names for characters and accents.
SIGNS = {"\\ss": "ß", "\\o": "ø", "\\O": "Ø", "\\ae": "æ", "\\AE": "Æ", "\\oe": "œ", "\\OE": "Œ", "\\aa": "å", "\\AA": "Å", "\\l": "ł", "\\L": "Ł", "\\i": "ı", "\\j": "ȷ", "\\ldots": "…", "\\dots": "…", "\\LaTeX": "LaTeX", "\\TeX": "TeX", "\\textbackslash": "\\", "\\textasciitilde": "~", "\\textasciicircum": "^", "\\S": "§", "\\copyright": "©", "\\pounds": "£", "\\quad": " ", "\\qquad": " "}
ACCENTS = {"\\'": "\u0301", "\\`": "\u0300", "\\^": "\u0302", '\\"': "\u0308", "\\~": "\u0303", "\\=": "\u0304", "\\.": "\u0307", "\\c": "\u0327", "\\v": "\u030c", "\\u": "\u0306", "\\H": "\u030b", "\\k": "\u0328", "\\r": "\u030a"}
LIGATURES = (("---", "—"), ("--", "–"), ("``", "“"), ("''", "”"))
#: Commands that take their arguments with them, environments that go whole, and commands that stand on lines of their own.
GONE = frozenset("\\cite \\citep \\citet \\citealt \\nocite \\ref \\eqref \\pageref \\label \\input \\include \\includegraphics \\usepackage \\documentclass \\bibliography \\bibliographystyle \\vspace \\hspace \\setlength \\pagestyle \\thispagestyle \\hyphenation \\index \\thanks \\footnotemark \\graphicspath \\setcounter \\addtocounter".split())
GONE_WHOLE = frozenset("figure figure* table table* tikzpicture thebibliography comment equation equation* align align* eqnarray eqnarray* gather gather* multline multline* math displaymath".split())
MATHS = frozenset("equation equation* align align* eqnarray eqnarray* gather gather* multline multline* math displaymath".split())
RAW = frozenset("verbatim verbatim* lstlisting".split())
BREAKS = frozenset("\\part \\chapter \\section \\subsection \\subsubsection \\paragraph \\title \\author \\item \\par \\begin \\end \\maketitle".split())
BREAK = "\n\n"


class _Reader:
    def __init__(self, source: str, math: bool) -> None:
        self.tokens = _TOKEN.findall(source)[::-1]
        self.left = GROWTH * len(self.tokens) + 1000
        self.math, self.macros, self.out = math, {}, []

    def skip_blanks(self) -> None:
        while self.tokens and (self.tokens[-1].isspace() and BREAK[0] * 2 not in self.tokens[-1].replace(" ", "") or self.tokens[-1][0] == "%"):
            self.tokens.pop()

    def group(self, opens: str = "{", closes: str = "}") -> list[str] | None:
        """The tokens of the group that follows, or None."""
        self.skip_blanks()
        if not self.tokens or self.tokens[-1] != opens:
            return None
        self.tokens.pop()
        depth, found = 0, []
        while self.tokens:
            token = self.tokens.pop()
            if token == closes and not depth:
                return found
            if opens == "{" or token in "{}":
                depth += (token == "{") - (token == "}")
            found.append(token)
        return found

    def argument(self) -> list[str]:
        """A group, or the one token that follows."""
        found = self.group()
        if found is not None:
            return found
        if not self.tokens:
            return []
        token = self.tokens.pop()
        if token[0] not in "\\{}[]$" and len(token) > 1:
            self.tokens.append(token[1:])
            token = token[0]
        return [token]

    def push(self, tokens: list[str]) -> bool:
        """Put tokens in front; whether the budget allows it."""
        self.left -= len(tokens)
        if self.left >= 0:
            self.tokens += tokens[::-1]
        return self.left >= 0

    def define(self, command: str) -> None:
        if command == "\\def":
            self.skip_blanks()
            name = self.tokens.pop().strip() if self.tokens else ""
            taken = 0
            while self.tokens and self.tokens[-1] != "{":
                taken += self.tokens.pop() == "#"
            default = None
        else:
            name = "".join(self.group() or [self.tokens.pop() if self.tokens else ""]).strip()
            count = "".join(self.group("[", "]") or []).strip()
            taken = int(count) if count.isdigit() else 0
            default = self.group("[", "]")
        body = self.group() or []
        if name.startswith("\\") and not (command.startswith("\\provide") and name in self.macros):
            self.macros[name] = (taken, default, body)

    def expand(self, name: str) -> None:
        taken, default, body = self.macros[name]
        given = []
        if default is not None and taken:
            own = self.group("[", "]")
            given.append(default if own is None else own)
        while len(given) < taken:
            given.append(self.argument())
        made, at = [], 0
        while at < len(body):
            token = body[at]
            number = body[at + 1][0] if token == "#" and at + 1 < len(body) else ""
            if number.isdigit() and 0 < int(number) <= len(given):
                made += given[int(number) - 1]
                at += 1
                if len(body[at]) > 1:
                    made.append(body[at][1:])
            else:
                made.append(token)
            at += 1
            if len(made) > self.left:
                break
        self.push(made)

    def until(self, ends: tuple[str, ...]) -> list[str]:
        """The tokens up to one of ``ends`` or, outside of environments, to a blank line."""
        found = []
        while self.tokens:
            token = self.tokens.pop()
            if token.strip() in ends:
                break
            if token.count("\n") > 1:
                self.tokens.append(token)
                break
            found.append(token)
        return found

    def environment(self, name: str, keep: bool) -> str:
        """The source of the environment that has begun, with those nested in it."""
        depth, found = 1, []
        while self.tokens:
            token = self.tokens.pop()
            bare = token.strip()
            if bare in ("\\begin", "\\end") and self.tokens and self.tokens[-1] == "{":
                inner = self.group() or []
                if "".join(inner).strip() == name:
                    depth += 1 if bare == "\\begin" else -1
                    if not depth:
                        break
                token += "{" + "".join(inner) + "}"
            if keep:
                found.append(token)
        return "".join(found)

    def command(self, token: str) -> None:
        name = token.strip()
        plain = name.rstrip("*") if len(name) > 2 else name
        if name in self.macros:
            self.expand(name)
        elif plain in ("\\newcommand", "\\renewcommand", "\\providecommand", "\\DeclareRobustCommand", "\\def", "\\DeclareMathOperator"):
            self.define(plain)
        elif name in ("\\(", "\\["):
            self.formula(self.until(("\\)", "\\]")))
        elif plain == "\\begin":
            kind = "".join(self.group() or []).strip()
            if kind in RAW:
                self.out += [BREAK, self.environment(kind, True), BREAK]
            elif kind in GONE_WHOLE:
                inside = self.environment(kind, self.math and kind in MATHS)
                self.out += [BREAK, inside, BREAK] if inside else [BREAK]
            else:
                self.group("[", "]")
                if kind in ("tabular", "tabular*", "array", "minipage"):
                    self.group()
                self.out.append(BREAK)
        elif plain == "\\end":
            self.group()
            self.out.append(BREAK)
        elif plain in GONE:
            while self.group("[", "]") is not None:
                pass
            while self.tokens and self.tokens[-1] == "{":
                self.group()
        elif plain in ACCENTS and (name in ACCENTS):
            letter = self.argument()
            text = "".join(SIGNS.get(x.strip(), x) for x in letter)
            text = {"ı": "i", "ȷ": "j"}.get(text[:1], text[:1]) + text[1:]
            self.out.append(unicodedata.normalize("NFC", text[:1] + ACCENTS[name] + text[1:]) if text else "")
        elif plain in SIGNS:
            self.out.append(SIGNS[plain])
        elif plain == "\\href":
            self.group()
        elif name == "\\\\":
            self.group("[", "]")
            self.out.append(" ")
        elif len(name) <= 2 and not name[1:].isalpha():
            self.out.append(name[1:] if name[1:] in "%&_$#{}" and len(name) > 1 else " " if name[1:] in ("", ",", ";", ":", "/") else "")
        else:
            if plain in BREAKS:
                self.out.append(BREAK)
            self.group("[", "]")

    def formula(self, tokens: list[str]) -> None:
        if self.math:
            self.out.append("".join(tokens))

    def text(self) -> str:
        breaks: list[int] = []  # depths of groups behind which a line ends
        depth = 0
        while self.tokens:
            token = self.tokens.pop()
            first = token[0]
            if first == "\\":
                before = len(self.out)
                self.command(token)
                if token.strip().rstrip("*") in BREAKS and len(self.out) > before and self.tokens and self.tokens[-1] == "{":
                    breaks.append(depth)
            elif first == "%" or token in ("^", "_", "#"):
                continue
            elif token == "{":
                depth += 1
            elif token == "}":
                depth = max(0, depth - 1)
                if breaks and breaks[-1] == depth:
                    breaks.pop()
                    self.out.append(BREAK)
            elif token in ("$", "$$"):
                self.formula(self.until((token,)))
            elif token == "&" or token == "~":
                self.out.append(" ")
            elif token.count("\n") > 1:
                self.out.append(BREAK)
            elif token in "[]" or token == "\n":
                self.out.append(token)
            else:
                for mark, sign in LIGATURES:
                    token = token.replace(mark, sign)
                self.out.append(token)
        blocks = (" ".join(b.split()) for b in re.split(r"\n[ \t]*\n\s*", "".join(self.out)))
        return "\n\n".join(b for b in blocks if b)


def tex_to_text(source: str | None, math: bool = False) -> str | None:
    """Paragraphs of text, with a blank line between them."""
    if source is None:
        return None
    head, begun, body = source.partition("\\begin{document}")
    if not begun:
        return _Reader(source, math).text()
    preamble = _Reader(head, math)
    preamble.text()  # for its macros
    reader = _Reader(body.partition("\\end{document}")[0], math)
    reader.macros = preamble.macros
    return reader.text()


def tex_text(c: Column, math: bool = False) -> Column:
    """Text of a column of TeX sources, in Arrow batches."""
    run = F.pandas_udf(lambda s: pd.Series([tex_to_text(x, math) for x in s], dtype=object), "string")
    return run(c)
