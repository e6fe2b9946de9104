"""Patterns written in the ECMAScript dialect, as Java patterns with the same meaning.

White space is the Unicode set, word boundaries are ASCII, and ``$`` without
the multi-line flag is the very end of the text.
"""

from __future__ import annotations

#: White space of ECMAScript, for use inside a character class.
SPACE = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
BLANK = SPACE.replace(r"\n", "")
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
#: Code points drawn as pictures; Java 17 has no property for them.
PICTURE = r"\x{A9}\x{AE}\x{203C}\x{2049}\x{2122}\x{2139}\x{2194}-\x{21AA}\x{231A}-\x{23FF}\x{24C2}\x{25AA}-\x{25FE}\x{2600}-\x{27BF}\x{2934}-\x{2B55}\x{3030}\x{303D}\x{3297}\x{3299}\x{1F000}-\x{1FAFF}"


def java(pattern: str, flags: str = "") -> str:
    """``pattern`` for Java. Flags: i (ignore case), m (lines), u (Unicode case)."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if pattern.startswith(r"[^\S\n]", i):
            out.append(f"[{BLANK}]")
            i += 7
        elif pattern.startswith(r"\p{Extended_Pictographic}", i):
            out.append(PICTURE if inside else f"[{PICTURE}]")
            i += 25
        elif pattern.startswith(r"\u{", i):
            out.append(r"\x{")
            i += 3
        elif two == r"\s":
            out.append(SPACE if inside else f"[{SPACE}]")
            i += 2
        elif two == r"\S":
            out.append(f"[^{SPACE}]")
            i += 2
        elif two == r"\b" and not inside:
            out.append(EDGE)
            i += 2
        elif pattern[i] == "\\":
            out.append(two)
            i += 2
        elif inside:
            inside = pattern[i] != "]"
            out.append(r"\[" if pattern[i] == "[" else pattern[i])
            i += 1
        else:
            inside = pattern[i] == "["
            out.append(r"\z" if pattern[i] == "$" and "m" not in flags else pattern[i])
            i += 1
    mode = ("i" if "i" in flags else "") + ("u" if "i" in flags and "u" in flags else "") + ("md" if "m" in flags else "")
    return (f"(?{mode})" if mode else "") + "".join(out)
