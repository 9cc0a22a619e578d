"""Regular expressions that cut source text into *chunks*.

A chunk is everything up to and including the next structural character
(``{ } ( ) [ ] ;``) that stands outside comments and literals. Round and square
groups that hold no statement are taken as one piece, so a whole signature such
as ``pub fn f(a: [u8; 4]) -> T {`` is one chunk and one row.

All loops are possessive: the JVM runs them iteratively, so neither a literal of
many megabytes nor a long file can exhaust the stack, and an unterminated
literal or comment runs to the end of the text instead of being retried.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

#: What `\s` matches.
BLANKS = " \t\n\x0b\f\r"
GROUP_DEPTH = 4  # of groups taken as one piece; deeper ones are followed as structure
# Levels that one pattern follows; `nesting.peeled` applies it until none are left.
PEEL_LEVELS = 5
ATTRIBUTE_DEPTH = 8

_ids = count()


def _hash_fenced() -> str:
    """``"..."`` closed by as many ``#`` as opened it (group names must differ)."""
    name = f"f{next(_ids)}"
    return rf'(?<=(?<!\w)[bc]?r)(?<{name}>#*+)"[\s\S]*?(?:"\k<{name}>|\z)'


def _quote_fenced() -> str:
    """Text between two runs of three or more quotes of the same length."""
    name = f"q{next(_ids)}"
    return rf'\$*+(?<{name}>"{{3,}}+)[\s\S]*?(?:\k<{name}>(?!")|\z)'


# Block comments hold no others: `nesting.flat_comments` sees to that where a language nests them.
_BLOCK_COMMENT = r"/\*(?:[^*]++|\*(?!/))*+(?:\*/|\z)"


@dataclass(frozen=True)
class Lexicon:
    """The lexical facts of one language, as regex fragments."""

    run: str  # characters that never need a closer look
    comments: str
    strings: object  # callable: alternatives for literals, in order
    loose: str  # single characters left over
    in_brackets: str  # what else a round or square group may hold

    def piece(self, depth: int) -> str:
        parts = [self.run, self.strings(), self.comments]
        if depth:  # a group closes with its own sign, else it is followed as structure
            for open_, close in ((r"\(", r"\)"), (r"\[", r"\]")):
                parts.append(rf"{open_}(?:{self.piece(depth - 1)}{self.in_brackets})*+{close}")
        if self.extra and depth == GROUP_DEPTH:
            parts.append(self.extra)
        parts.append(self.loose)
        return "|".join(parts)

    extra: str = ""
    plain_ahead: str = ""  # lookahead: no definition begins here

    @property
    def chunk(self) -> str:
        return rf"(?:{self.piece(GROUP_DEPTH)})++[;{{}}()\[\]]?|[;{{}}()\[\]]"

    @property
    def merged_chunk(self) -> str:
        """Chunks that run on over ``;`` between statements that declare nothing.
        What follows a closer may end a definition and still stops at its ``;``."""
        inside, alone = self.piece(GROUP_DEPTH), self.piece(GROUP_DEPTH)
        end = r"[;{}()\[\]]"
        return (
            rf"(?<![}})\]]){self.plain_ahead}(?:{inside}|;{self.plain_ahead})++{end}?|(?:{alone})++{end}?|{end}"
        )

    @property
    def token(self) -> str:
        """One comment, one literal, one run of other text or one character."""
        return rf"(?<c>{self.comments})|(?<s>{self.strings()})|{self.run}|[\s\S]"


def _rust_strings() -> str:
    return (
        _hash_fenced()
        + r'|"(?:[^"\\]++|\\[\s\S])*+(?:"|\z)'
        + r"|'(?:[^'\\\n]|\\(?:u\{[0-9a-fA-F_]*+\}|x[0-9a-fA-F]{2}|[^ux\n]))'"
    )


def _csharp_strings() -> str:
    return (
        _quote_fenced()
        + r'|(?:@\$?|\$@)"(?:[^"]++|"")*+(?:"|\z)'
        + r'|\$"(?:[^"\\{\n]++|\\.|\{\{|\{(?:[^{}"\n]++|"(?:[^"\\\n]++|\\.)*+")*+\})*+"'
        + r'|"(?:[^"\\\n]++|\\.)*+(?:"|(?=\n)|\z)'
        + r"|'(?:[^'\\\n]|\\.[0-9a-fA-F]{0,8})'"
    )


def _balanced(open_: str, close: str, inside: str, depth: int) -> str:
    inner = rf"|{_balanced(open_, close, inside, depth - 1)}" if depth else ""
    return rf"{open_}(?:{inside}{inner})*+{close}"


def _statement_free_braces(strings: str) -> str:
    """Braces of a value: literals, groups and words, but no statement and no block."""
    rounds = _balanced(r"\(", r"\)", rf"[^(){{}};\"'/#]++|{strings}", 3)
    squares = _balanced(r"\[", r"\]", rf"[^\[\]{{}};\"'/#]++|{strings}", 3)
    return rf"\{{(?:[^{{}}()\[\];\"'/#$@]++|{strings}|{rounds}|{squares})*+\}}"


_RUST_QUOTED = r'"(?:[^"\\]++|\\[\s\S])*+"' + r"|'(?:[^'\\\n]|\\[^\n])'"
_CS_QUOTED = r'@\$?"(?:[^"]++|"")*+"|"(?:[^"\\\n]++|\\.)*+"' + r"|'(?:[^'\\\n]|\\.[0-9a-fA-F]{0,8})'"

# Words that can begin a Rust definition; `#` begins an attribute.
_RUST_HEAD_WORDS = r"(?:#|(?:pub|fn|struct|enum|trait|impl|const|static|unsafe|async|extern|default|auto|safe)\b)"
# A C# assignment, complete call or keyword statement.
_CS_PLAIN_START = (
    r"(?:[\w.]++\s*+(?:[-+*/%&|^?]{0,2}=(?![=>])|\+\+|--|\([^(){};\"'/]*+\)\s*+;)"
    r"|(?:return|throw|break|continue|yield|goto|if|for|foreach|while|switch|try|lock|case|do|var)\b)"
)

RUST = Lexicon(
    run=r"""[^"'/(){}\[\];#]++""",
    comments=rf"//[^\n]*+|{_BLOCK_COMMENT}",
    strings=_rust_strings,
    loose="[#'/]",
    in_brackets=rf"|;|{_statement_free_braces(_RUST_QUOTED)}",
    # const generic argument
    extra=rf"(?<=[<,]\s{{0,200}}){_statement_free_braces(_RUST_QUOTED)}(?=\s*[,>])",
    plain_ahead=rf"(?!(?:\s++|//[^\n]*+|{_BLOCK_COMMENT})*+{_RUST_HEAD_WORDS})",
)

CSHARP = Lexicon(
    run=r"""[^"'/(){}\[\];#$@]++""",
    comments=rf"//[^\n]*+|{_BLOCK_COMMENT}|#[^\n]*+",  # '#' opens a directive line
    strings=_csharp_strings,
    loose="[$@'/]",
    in_brackets=rf"|;|{_statement_free_braces(_CS_QUOTED)}",
    plain_ahead=rf"(?=(?:\s++|//[^\n]*+)*+{_CS_PLAIN_START})",
)

LEXICONS = {"rust": RUST, "csharp": CSHARP}

# --- Rust heads -----------------------------------------------------------------

RUST_COMMENT = RUST.comments
_RS_OUTER_DOC = r"///(?!/)[^\n]*+|/\*\*(?![*/])(?:[^*]++|\*(?!/))*+\*/"
_RS_PLAIN = rf"(?!///(?!/)|/\*\*(?![*/]))(?:{RUST_COMMENT})"


def _attribute(strings, comments: str, loose: str, depth: int = ATTRIBUTE_DEPTH) -> str:
    """A square group with literals and comments in it, and further square groups."""
    inner = rf"|{_attribute(strings, comments, loose, depth - 1)}" if depth else ""
    return rf"\[(?:[^\[\]\"'/#$@]++|{strings()}|{comments}{inner}|{loose})*+\]"


def _rs_attribute() -> str:  # group names must differ, so each use is made anew
    return _attribute(_rust_strings, r"//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+\*/", "[#'/$@]")
# Whitespace, plain comments, the shebang and inner attributes: not part of an item.
RUST_LEAD = rf"^(?:\s++|{_RS_PLAIN}|#!\s*+{_rs_attribute()}|#![^\[\n]*+)*+"
# ... and then doc comments and outer attributes, which are.
RUST_PREFIX = rf"{RUST_LEAD}(?:\s++|{RUST_COMMENT}|#\s*+{_rs_attribute()})*+"
RUST_ATTRIBUTE_OPEN = rf"{RUST_PREFIX}#\s*+\["
RUST_TEST_ATTRIBUTE = r"#\s*\[\s*(?:r#)?test\s*[\]\(=]"

_RS_GAP = rf"(?:\s|{RUST_COMMENT})"
_RS_QUALIFIERS = (
    rf"(?:(?:pub(?:\s*\([^)]*\))?|default|unsafe|async|auto|safe"
    rf"|const(?={_RS_GAP}+(?:unsafe|async|extern|fn)\b)"
    rf"|extern(?:\s*(?:r#*)?\"[^\"]*\"#*)?(?={_RS_GAP}+fn\b)){_RS_GAP}++)*+"
)
RUST_IDENT = r"(?:r#)?\w+"
_RS_DEFINITION = (
    rf"{_RS_QUALIFIERS}"
    rf"(?:(fn|struct|enum|trait|const|static){_RS_GAP}++(?:mut\b{_RS_GAP}++)?({RUST_IDENT})|(impl)\b(?!\s*!?\s*\())"
)
_RS_VALUE = rf"{_RS_QUALIFIERS}(?:const|static){_RS_GAP}++(?:mut\b{_RS_GAP}++)?{RUST_IDENT}{_RS_GAP}*+:"
_RS_EXTERN = r"(?:unsafe\s+)?extern(?:\s*(?:r#*)?\"[^\"]*\"#*)?\s*\{\z"
# Each in two forms: after any prefix, and for chunks that begin with neither a comment nor an
# attribute (RUST_MARKED). A matcher of the long prefix costs more than the match.
RUST_MARKED = r"\A\s*+[/#]"
RUST_HEAD, RUST_BARE_HEAD = rf"{RUST_PREFIX}{_RS_DEFINITION}", rf"\A\s*+{_RS_DEFINITION}"
RUST_VALUE_HEAD, RUST_BARE_VALUE_HEAD = rf"{RUST_PREFIX}{_RS_VALUE}", rf"\A\s*+{_RS_VALUE}"
RUST_EXTERN_BLOCK, RUST_BARE_EXTERN_BLOCK = rf"{RUST_PREFIX}{_RS_EXTERN}", rf"\A\s*+{_RS_EXTERN}"
RUST_MACRO_OPEN = r"\w![\s]*[({\[]\z|\bmacro_rules\s*!\s*\w+\s*[({\[]\z"

# --- C# heads -------------------------------------------------------------------

CS_COMMENT = CSHARP.comments
def _cs_attribute() -> str:
    return _attribute(_csharp_strings, r"//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+\*/", "[#'/$@]")


CS_LEAD = rf"^(?:\s++|{CS_COMMENT}|(?=\[\s*(?:assembly|module)\s*:){_cs_attribute()})*+"
CS_PREFIX = rf"{CS_LEAD}(?:\s++|{CS_COMMENT}|{_cs_attribute()})*+"
# A chunk that begins otherwise has only blanks as its lead and prefix.
CS_MARKED = r"\A\s*+[/#\[]"

# Text that begins, after directives, with a namespace or a type: C# allows no
# statements at the top of such a file.
CS_TYPES_FIRST = (
    rf"^(?:\s++|{CS_COMMENT}|{_cs_attribute()}|(?:global\s+)?using\s[^;({{]*+;|extern\s+alias\s[^;]*+;)*+"
    r"(?:(?:public|internal|static|sealed|abstract|partial|readonly|unsafe|ref|file)\s++)*+"
    r"(?:namespace|class|struct|interface|enum|record|delegate)\b"
)

# Words that can stand before a member's type.
_CS_MODIFIER_WORDS = (
    "public|private|protected|internal|static|sealed|abstract|partial|readonly|unsafe"
    "|new|override|virtual|extern|async|const|ref|file|required|volatile|fixed"
)
CS_MODIFIERS = rf"^(?:(?:{_CS_MODIFIER_WORDS})\b\s*+)*+"
CS_NAME = r"@?\w+"


# Round groups, type arguments, and array or nullable marks, to be taken out so
# that what is left of a signature is words, `()` and the sign that ends it.
CS_PARENS = _balanced(r"\(", r"\)", "[^()]++", PEEL_LEVELS - 1)
CS_TYPE_ARGUMENTS = _balanced("<", ">", r"[\w\s,.?\[\]():*@]++", PEEL_LEVELS - 1)
CS_TYPE_MARKS = r"\s*\[[^\[\]]*+\]|[?*]"
CS_INDEXER = r"^[^={;(]*?\bthis\s*\["

# A statement that cannot declare anything: an assignment, a call, a keyword.
CS_PLAIN = (
    r"^(?:[\w.]+\s*(?:[-+*/%&|^?]{0,2}=(?![=>])|\+\+|--)|[\w.]+\s*\([^(){};]*+\)\s*;\z"
    r"|(?:return|throw|break|continue|yield|goto|if|for|foreach|while|switch|else|do|try|catch|finally|lock|case|var|await)\b)"
)
CS_DECLARED = rf"^(class|struct|interface|enum|record|namespace|delegate|event|using)\b"
CS_TYPE_NAME = rf"^(?:record\s+(?:class|struct)|\w+)\s+({CS_NAME})"
CS_CONVERSION = r"\b(implicit|explicit)\s+(?:[\w.]+\.\s*)?operator\s+(?:checked\s+)?([^()]+?)\s*\("
CS_OPERATOR = r"\boperator\s*(?:checked\s+)?(true\b|false\b|[^\s\w()]+)\s*\(\)"
CS_CALL_NAME = rf"({CS_NAME})\s*\(\)"
CS_FIRST_DECLARATOR = rf"^[^,]*?({CS_NAME})\s*(?:,|\z)"
CS_LAST_NAME = rf"\W({CS_NAME})\s*\z"
CS_CONST = rf"^(?:(?:{_CS_MODIFIER_WORDS})\s+)*?const\b"
CS_STATIC = rf"^(?:(?:{_CS_MODIFIER_WORDS})\s+)*?static\b"
CS_ACCESSOR = r"^(get|set|init|add|remove)\s*(?:[{;]\z|=>)"
CS_SIGN = r"^[^={;]*+(=>|=|\{|;)"

# Words that begin a statement, so no local function follows.
_CS_NOT_TYPE = (
    "return|await|else|throw|yield|case|goto|in|is|as|when|if|while|for|foreach|switch"
    "|using|lock|catch|fixed|do|try|finally|new|checked|unchecked|default|and|or|not|out"
)
_CS_NOT_NAME = "if|while|for|foreach|switch|using|lock|catch|fixed|when|nameof|typeof|sizeof|default|new|base|this"
CS_LOCAL_FUNCTION = (
    rf"^(?!(?:{_CS_NOT_TYPE})\b)(?:[\w.:@]++|\(\))\s*(?<=[\s)])(?!(?:{_CS_NOT_NAME})\b)({CS_NAME})\s*\(\)\s*(?:where\b|\z)"
)
CS_USING = r"^(?:global\s+)?using\s+(?:static\s+|unsafe\s+)*[\w.:@]+(?:\s*<[^;]*>)?\s*;\z|^(?:global\s+)?using\s+(?:unsafe\s+)?\w+\s*=\s*[^;]*;\z|^extern\s+alias\b"
CS_BLOCK_STATEMENT = (
    r"^(?:\w+\s*:\s*)?(?:\{|(?:if|for|foreach|while|do|switch|try|catch|finally|else|lock|unsafe|fixed"
    r"|checked|unchecked|await\s+foreach|(?:await\s+)?using\s*\()(?:\b|\W))"
)
CS_CONTINUATION = r"^(?:else|catch|finally)\b"
CS_DO = r"^do\b"
CS_WHILE_TAIL = r"^while\b[\s\S]*;\z"
