"""Code files cut into top-level functions and classes.

Each file is handled inside its own row (files are at most 1 MiB), by array functions only:
no line is exploded, shuffled or sent to Python. Literals and comments are blanked first
without moving anything, so that positions and line numbers stay those of the file.

* Indented languages: a block runs to the last line before one that is indented no deeper.
* Braced languages: the text is cut at block heads and braces; a block runs from its head
  to the brace that closes it.

A block found inside an open block is part of that block. A slash opens a regular-expression literal where an operand
is due (after an operator, an opening bracket or a keyword). The body of an arrow function without braces goes on in the
next line where a line ends or the next one opens with an operator. What a full parser would see and this does not: heads
made by macros.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditmill import params as P
from auditmill import schemas
from auditmill.functions.text import base_name, let, line_count

# Marks from the private-use range: a filled literal, and both ends of a block head.
FILL, HEAD_START, HEAD_END = "\ue000", "\ue001", "\ue002"
MARKS = FILL + HEAD_START + HEAD_END
ANONYMOUS = "<anonymous>"

# Literals and comments. Every loop is possessive: none backtracks or recurses.
_DOUBLE = r'"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+"?'
_SINGLE = r"'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'?"
_TRIPLE = r'"""[\s\S]*?(?:"""|\z)' + r"|'''[\s\S]*?(?:'''|\z)"
_TEMPLATE = r"`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`?"
_RAW = r"`[^`]*+`?"
_SLASHES = r"//[^\n]*+|/\*(?:[^*]|\*(?!/))*+(?:\*/)?"
_HASH = r"#[^\n]*+"
_DIRECTIVE = r"#(?:[^\n\\]|\\[\s\S])*+"


# A slash opens a literal where an operand is due: after an operator, an opening bracket or one of some keywords, and
# blanks; not after ++ and --. Within a class of characters a slash ends nothing.
_DUE = (r"(?<=(?:\A|[(,=:\[!&|?{;+*%~^-]|=>|\b(?:return|typeof|case|in|of|delete|void|throw|do|else))\s{0,16})"
        r"(?<!\+\+\s{0,16})(?<!--\s{0,16})")
_REGEX = _DUE + r"/(?![/*])(?:[^/\\\[\n]++|\\[^\n]|\[(?:[^\]\\\n]++|\\[^\n])*+\])++/[a-z]*+"


def _nested(inner: str) -> str:
    """Parentheses with up to two further levels in them; `inner` is what else may occur."""
    deep = rf"\((?:[^(){{}};]++|{inner})*+\)"
    mid = rf"\((?:[^(){{}};]++|{inner}|{deep})*+\)"
    return rf"\((?:[^(){{}};]++|{inner}|{mid})*+\)"


@dataclass(frozen=True)
class Head:
    """The start of a block: its kind, a regex and, as group 1 of it, the name if it has one."""

    kind: str
    regex: str
    named: bool = True


@dataclass(frozen=True)
class BracedLanguage:
    blanks: str
    heads: tuple[Head, ...]


_EMPTY_BRACES = r"\{\s*\}"

_JAVA_MARKS = (
    r"(?:(?:@[\w.]+(?:\s*" + _nested(r"\{[^{}]*+\}") + r")?|public|private|protected|static|final|abstract"
    r"|synchronized|native|strictfp|default|sealed|non-sealed)\s+)*+"
)
_JAVA_TAIL = r"\s*(?:throws\s[^{};]+)?"
_JAVA_PARAMS = _nested(r"\{[^{}]*+\}")
_JAVA = BracedLanguage(
    f"{_TRIPLE}|{_DOUBLE}|{_SINGLE}|{_SLASHES}",
    (
        Head("class", _JAVA_MARKS + r"class\s+(\w+)[^{};]*+\{"),
        Head(
            "function",
            _JAVA_MARKS + r"(?:<[^(){};]*>\s*)?(?!(?:return|new|else|throw|case|record|package|import)\b)"
            r"[\w.]++(?:<[^(){};]*>)?(?:\s*\[\s*\])*+\s++(?!(?:if|for|while|switch|catch)\b)(\w++)\s*+"
            + _JAVA_PARAMS + r"(?:\s*\[\s*\])*" + _JAVA_TAIL + r"[{;]",
        ),
        Head(
            "class",
            r"(?<!new\s)(?<!record\s)" + _JAVA_MARKS + r"(?!(?:if|for|while|switch|catch|synchronized|try|record)\b)(\w++)\s*+"
            + _JAVA_PARAMS + _JAVA_TAIL + r"\{",
        ),
    ),
)

_GO_PARAMS = _nested(_EMPTY_BRACES)
_GO_RESULT = r"(?:[^{}\n]|\{\s*\}(?=[^\n]*\{))*+\{"
_GO = BracedLanguage(
    f"{_DOUBLE}|{_SINGLE}|{_RAW}|{_SLASHES}",
    (
        Head("function", r"func\s+(\w+)\s*(?:\[[^\]]*\])?\s*" + _GO_PARAMS + _GO_RESULT),
        Head("function", r"func\s*\([^()]*+\)\s*(\w+)\s*" + _GO_PARAMS + _GO_RESULT),
    ),
)

_JS_PARAMS = _nested(r"\{[^{}]*+\}")
_JS_TYPE = r"(?:\s*:\s*[^{};=]+)?\s*"
_JS_PAREN = r"\((?:[^()]++|\((?:[^()]++|\((?:[^()]++|\([^()]*+\))*+\))*+\))*+\)"
_JS_BRACKET = r"\[(?:[^\[\]]++|\[(?:[^\[\]]++|\[[^\[\]]*+\])*+\])*+\]"
_JS_GOES_ON = r"\n(?=[ \t]*+(?:[.?:+*%&|<>=^-]|/(?![/*])))|(?<=[.?:+*/%&|<>=^-][ \t]{0,8})\n"
_JS_BODY = rf"(?:[^\n;,(){{}}\[\]]++|{_JS_PAREN}|{_JS_BRACKET}|{_JS_GOES_ON})++"
_JS_KEYWORDS = r"(?!(?:if|for|while|switch|catch|with|return|function|do|else|try|typeof|new|await)\b)"
_JS = BracedLanguage(
    f"{_DOUBLE}|{_SINGLE}|{_TEMPLATE}|{_SLASHES}|{_REGEX}",
    (
        Head(
            "function",
            r"(?:async\s+)?function(?![\w$])\s*([\w$]+)?\s*(?:<[^(){}]*>)?\s*" + _JS_PARAMS + _JS_TYPE + r"\{",
        ),
        Head("function", r"(?:async\s*)?(?:" + _JS_PARAMS + _JS_TYPE + r"|[\w$]++\s*+)=>\s*\{", named=False),
        Head(
            "function",
            r"(?:async\s*)?(?:" + _JS_PARAMS + _JS_TYPE + r"|[\w$]++\s*+)=>\s*(?![\s{])" + _JS_BODY,
            named=False,
        ),
        Head("class", r"(?<!abstract\s)(?<![=(,:]\s)(?<![=(,:])class\s+([\w$]+)[^{};]*+\{"),
        Head(
            "function",
            r"(?<!function\*)(?<!function\*\s)(?<!function\s\*)"
            r"(?:(?:async|static|get|set|public|private|protected|readonly|override)\s+)*+" + _JS_KEYWORDS
            + r"([\w$#]++)\s*+(?:<[^(){}]*>)?" + _JS_PARAMS + _JS_TYPE + r"\{",
        ),
    ),
)

_C_KEYWORDS = r"(?!(?:if|else|for|while|switch|return|do|case|sizeof|catch|new|delete|throw)\b)"
_C_PARAMS = _nested(r"\{[^{}]*+\}")
_C = BracedLanguage(
    f"{_DOUBLE}|{_SINGLE}|{_SLASHES}|{_DIRECTIVE}",
    (
        Head(
            "function",
            r"(?:" + _C_KEYWORDS + r"[A-Za-z_]\w*+(?:\s*\*+\s*|\s+)){1,8}" + _C_KEYWORDS + r"[A-Za-z_]\w*\s*"
            + _C_PARAMS + r"\s*\{",
            named=False,
        ),
    ),
)
_CPP = BracedLanguage(
    f"{_DOUBLE}|{_SINGLE}|{_SLASHES}|{_DIRECTIVE}",
    (
        Head("class", r"(?<!enum\s)class\s+([\w:]+)(?:\s+final)?\s*(?::[^{};()]*+)?\{"),
        Head(
            "function",
            r"(?:" + _C_KEYWORDS + r"[A-Za-z_][\w:]*+(?:<[^(){};]*?>)?(?:\s*[*&]+\s*|\s+)){0,8}" + _C_KEYWORDS
            + r"(?:operator\s*[^\s\w(]+|~?[A-Za-z_][\w:~]*)\s*" + _C_PARAMS
            + r"\s*(?:(?:const|noexcept|override|final|volatile)\b\s*|&+\s*)*(?:->[^{};()]+)?(?::[^{};]*)?\{",
            named=False,
        ),
    ),
)

BRACED = {"javascript": _JS, "typescript": _JS, "java": _JAVA, "go": _GO, "c": _C, "cpp": _CPP}
INDENTED = {"python": r"^([ \t]*)(async[ \t]+def|def|class)[ \t]+(\w+)"}
PYTHON_BLANKS = f"{_TRIPLE}|{_DOUBLE}|{_SINGLE}|{_HASH}"

BLOCKS = "array<struct<kind:string,name:string,line_start:int,line_end:int,code:string>>"


def _swap(text: Column, chars: str, by: str) -> Column:
    """The text with each of a few characters replaced. `translate` makes an object of every character of the text."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(by))
    return text


def blank_literals(text: Column, literals: str) -> Column:
    """The text with literals filled up and comments made blank; line ends stay in place."""
    known = _swap(text, MARKS, "?")
    pieces = F.regexp_extract_all(known, F.lit(rf"{literals}|[^\"'`/#]++|[\s\S]"), F.lit(0))

    def fill(piece: Column, by: str) -> Column:
        return F.when(F.contains(piece, F.lit("\n")), F.regexp_replace(piece, r"[^\n]", by)).otherwise(F.repeat(F.lit(by), F.length(piece)))

    def cover(piece: Column) -> Column:
        return (
            F.when(~F.left(piece, F.lit(1)).isin('"', "'", "`", "/", "#"), piece)  # most of the text, and no match of a literal
            .when(piece.rlike(r"\A(?:[\"'`]|/[^/*])"), fill(piece, FILL))  # a slash that divides stands alone
            .when(piece.rlike(r"\A(?:#|//|/\*)") & piece.rlike(rf"\A(?:{literals})"), fill(piece, " "))
            .otherwise(piece)
        )

    return F.array_join(F.transform(pieces, cover), "")


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(_swap(text, chars, ""))


def _tail(text: Column) -> Column:
    """How many characters follow the last line end."""
    return F.length(F.substring_index(text, "\n", -1))


def braced_blocks(text: Column, language: BracedLanguage) -> Column:
    """Blocks of a file in a language with braces."""
    head = rf"(?=[\w$@(<~#])(?<![\w$.])(?:{'|'.join(h.regex for h in language.heads)})"
    marked = F.regexp_replace(blank_literals(text, language.blanks), head, f"{HEAD_START}$0{HEAD_END}")
    # \G: after the last token the search ends at once and does not try every later position.
    pieces = F.regexp_extract_all(
        marked, F.lit(rf"\G[^{{}}{HEAD_START}]*+(?:{HEAD_START}[^{HEAD_END}]*+{HEAD_END}|[{{}}])"), F.lit(0))

    def token(piece: Column) -> Column:
        before = F.substring_index(piece, HEAD_START, 1)
        return let(_swap(piece, HEAD_START + HEAD_END, ""), lambda plain: F.struct(
            F.length(plain).alias("size"),
            _count(plain, "\n").alias("lines"),
            _tail(plain).alias("tail"),
            F.right(plain, F.lit(1)).alias("last"),
            F.regexp_extract(piece, rf"{HEAD_START}([^{HEAD_END}]*+){HEAD_END}", 1).alias("head"),
            F.contains(before, F.lit("\n")).alias("new_line"),
            _tail(before).alias("margin"),
        ))

    tokens = F.transform(pieces, token)
    found = "array<struct<head:string,margin:int,size:int,line_start:int,line_end:int>>"
    # `column` and `margin`: how many characters stand before this place, or before the block, in its line.
    zero = F.struct(
        F.lit(0).alias("at"), F.lit(1).alias("line"), F.lit(0).alias("column"), F.lit(0).alias("depth"),
        F.lit("").alias("head"), F.lit(0).alias("start"), F.lit(0).alias("margin"), F.lit(0).alias("line_start"),
        F.array().cast(found).alias("done"),
    )

    def step(s: Column, t: Column) -> Column:
        at, line = s["at"] + t["size"], s["line"] + t["lines"]
        opens = (s["depth"] == 0) & (t["head"] != "")
        single = opens & (t["last"] != "{")
        closes = (s["depth"] == 1) & (t["last"] == "}")
        start = F.when(opens, at - F.length(t["head"])).otherwise(s["start"])
        margin = F.when(~opens, s["margin"]).when(t["new_line"], t["margin"]).otherwise(s["column"] + t["margin"])
        line_start = F.when(opens, line - _count(t["head"], "\n")).otherwise(s["line_start"])
        text_head = F.when(opens, t["head"]).otherwise(s["head"])
        change = F.when(t["last"] == "{", 1).when(t["last"] == "}", -1).otherwise(0)
        block = F.struct(
            text_head.alias("head"), margin.alias("margin"), (at - start).alias("size"),
            line_start.alias("line_start"), line.alias("line_end"),
        )
        return F.struct(
            at.alias("at"),
            line.alias("line"),
            F.when(t["lines"] > 0, t["tail"]).otherwise(s["column"] + t["tail"]).alias("column"),
            F.when((s["depth"] > 0) | opens, s["depth"] + change).otherwise(0).alias("depth"),
            text_head.alias("head"),
            start.alias("start"),
            margin.alias("margin"),
            line_start.alias("line_start"),
            F.when(single | closes, F.concat(s["done"], F.array(block))).otherwise(s["done"]).alias("done"),
        )

    blocks = F.aggregate(tokens, zero, step, lambda s: s["done"])

    def describe(block: Column, lines: Column) -> Column:
        kind, name = F.lit("class"), F.lit(ANONYMOUS)
        for h in reversed(language.heads):
            fits = block["head"].rlike(rf"\A(?:{h.regex})\z")
            label = F.regexp_extract(block["head"], rf"\A(?:{h.regex})\z", 1) if h.named else F.lit("")
            kind = F.when(fits, h.kind).otherwise(kind)
            name = F.when(fits, F.when(label != "", label).otherwise(ANONYMOUS)).otherwise(name)
        # Cut from its own lines: a position in the whole text is found by counting from the first character.
        own = F.array_join(F.slice(lines, block["line_start"], block["line_end"] - block["line_start"] + 1), "\n")
        return F.struct(
            kind.alias("kind"), name.alias("name"), block["line_start"].alias("line_start"),
            block["line_end"].alias("line_end"), F.substring(own, block["margin"] + 1, block["size"]).alias("code"),
        )

    return let(F.split(text, "\n", -1), lambda lines: F.transform(blocks, lambda block: describe(block, lines)))


def indented_blocks(text: Column, start: str, literals: str) -> Column:
    """Blocks of a file in a language where indentation ends a block. `start` is a regex for
    the first line with three groups: indentation, keyword and name."""
    lines = F.transform(
        F.split(blank_literals(text, literals), "\n", -1),
        lambda line: F.struct(
            F.length(F.replace(F.regexp_extract(line, r"^[ \t]*", 0), F.lit("\t"), F.lit(" " * 8))).alias("indent"),
            line.rlike(r"^\s*$").alias("blank"),
            line.rlike(rf"^{FILL}").alias("inside"),
            (_count(line, "([{") - _count(line, ")]}")).alias("change"),
            F.regexp_extract(line, start, 2).alias("keyword"),
            F.regexp_extract(line, start, 3).alias("name"),
        ),
    )
    found = "array<struct<keyword:string,name:string,line_start:int,line_end:int>>"
    zero = F.struct(
        F.lit(0).alias("line"), F.lit(0).alias("depth"), F.lit(0).alias("open"), F.lit(0).alias("indent"),
        F.lit(0).alias("content"), F.lit("").alias("keyword"), F.lit("").alias("name"),
        F.array().cast(found).alias("done"),
    )

    def block(s: Column) -> Column:
        return F.array(F.struct(
            s["keyword"].alias("keyword"), s["name"].alias("name"),
            s["open"].alias("line_start"), s["content"].alias("line_end"),
        ))

    def step(s: Column, t: Column) -> Column:
        line = s["line"] + 1
        statement = ~t["blank"] & ~t["inside"] & (s["depth"] <= 0)
        ends = (s["open"] > 0) & statement & (t["indent"] <= s["indent"])
        free = (s["open"] == 0) | ends
        begins = free & statement & (t["keyword"] != "")
        return F.struct(
            line.alias("line"),
            (s["depth"] + t["change"]).alias("depth"),
            F.when(begins, line).when(ends, 0).otherwise(s["open"]).alias("open"),
            F.when(begins, t["indent"]).otherwise(s["indent"]).alias("indent"),
            F.when(~t["blank"], line).otherwise(s["content"]).alias("content"),
            F.when(begins, t["keyword"]).otherwise(s["keyword"]).alias("keyword"),
            F.when(begins, t["name"]).otherwise(s["name"]).alias("name"),
            F.when(ends, F.concat(s["done"], block(s))).otherwise(s["done"]).alias("done"),
        )

    def finish(s: Column) -> Column:
        return F.when(s["open"] > 0, F.concat(s["done"], block(s))).otherwise(s["done"])

    blocks = F.aggregate(lines, zero, step, finish)

    def describe(source: Column) -> Column:
        return F.transform(blocks, lambda b: F.struct(
            F.when(b["keyword"] == "class", "class").otherwise("function").alias("kind"),
            b["name"].alias("name"),
            b["line_start"].alias("line_start"),
            b["line_end"].alias("line_end"),
            F.regexp_replace(
                F.array_join(F.slice(source, b["line_start"], b["line_end"] - b["line_start"] + 1), "\n"),
                r"\A[ \t]+", "").alias("code"),
        ))

    return let(F.split(text, "\n", -1), describe)


def code_blocks(language: Column, text: Column, braced=None, indented=None) -> Column:
    """Blocks of a file by its language; empty for a language without rules."""
    out = F.array().cast(BLOCKS)
    for name, start in (indented or INDENTED).items():
        out = F.when(language == name, indented_blocks(text, start, PYTHON_BLANKS).cast(BLOCKS)).otherwise(out)
    rules = braced or BRACED
    for rule in dict.fromkeys(rules.values()):
        names = [n for n, r in rules.items() if r is rule]
        out = F.when(language.isin(*names), braced_blocks(text, rule).cast(BLOCKS)).otherwise(out)
    return out


def chunk_key(path: Column, line_start: Column, line_end: Column, name: Column, ordinal: Column) -> Column:
    """Key of a chunk. The ordinal tells apart two nameless blocks on one line."""
    parts = [path] + [c.cast("string") for c in (line_start, line_end)] + [name, ordinal.cast("string")]
    return F.sha2(F.concat_ws("\0", *parts), 256)


def segment_files(files: DataFrame, max_lines: int = P.MAX_CHUNK_LINES, braced=None, indented=None,
                  with_ordinal: bool = False) -> DataFrame:
    """Chunks of (path, language, content): the blocks, or the whole file where there are none.

    Chunks over `max_lines` are marked, never cut. `ordinal` is the place of a chunk in its file, from 0."""
    whole = F.array(F.struct(
        F.lit("module").alias("kind"),
        base_name(F.col("path")).alias("name"),
        F.lit(1).alias("line_start"),
        F.greatest(line_count(F.col("content")), F.lit(1)).alias("line_end"),
        F.col("content").alias("code"),
    )).cast(BLOCKS)
    blocks = code_blocks(F.col("language"), F.col("content"), braced, indented)
    chunks = (
        files.withColumn("blocks", blocks)
        .select("path", "language", F.posexplode(
            F.when(F.size("blocks") > 0, F.col("blocks")).otherwise(whole)).alias("ordinal", "b"))
    )
    return chunks.select(
        chunk_key(F.col("path"), F.col("b.line_start"), F.col("b.line_end"), F.col("b.name"), F.col("ordinal"))
        .alias("chunk_id"),
        F.col("path").alias("file_path"),
        "language",
        F.col("b.kind").alias("chunk_type"),
        F.col("b.name").alias("name"),
        F.col("b.code").alias("code"),
        F.col("b.line_start").alias("line_start"),
        F.col("b.line_end").alias("line_end"),
        (F.col("b.line_end") - F.col("b.line_start") + 1 > max_lines).alias("oversized"),
        *(["ordinal"] if with_ordinal else []),
    ).to(T.StructType([*schemas.CHUNKS.fields, *([T.StructField("ordinal", T.IntegerType())] if with_ordinal else [])]))
