"""String expressions: cleaning, labels, colours and page ranges."""

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that vanish from extracted text, and the whitespace that collapses.
STRIP = r"\x{AD}\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F"
WHITESPACE = r"\t\n\r\x20\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
BLANK = WHITESPACE + r"\x0B\x0C\x85"

# Kinds of text markup that are shown as highlights.
MARKUP_KINDS = ("underline", "strikeout", "squiggly")
# Where private-use characters begin that stand for letters without a lower-case form of their own.
PRIVATE_USE = 0xE000


def _folding() -> dict[str, str]:
    """Letters that lower-casing alone does not bring together with those of the same upper case, or wrongly
    does.

    Letters are the same if their upper case is the same single letter; ASCII letters are the same as no
    others. Each gets the lower case of that letter if this leads back to it, else a character of its own.
    The lower case of a capital sigma depends on what follows, so it is given here.
    """
    folding, own = {"\u03a3": "\u03c3"}, {}
    for c in filter(str.isprintable, map(chr, range(0x80, 0x1E944))):
        upper = _upper(c)
        low = upper.lower()
        if len(low) != 1 or _upper(low) != upper:
            low = c if c == upper and c.lower() == c else own.setdefault(upper, chr(PRIVATE_USE + len(own)))
        if c.lower() != low:
            folding[c] = low
    return folding


def _upper(c: str) -> str:
    """The upper case that is one letter; some have one only at the start of a word."""
    found = next((u for u in (c.upper(), c.title()) if len(u) == 1), c)
    return found if found.isascii() == c.isascii() else c


_FOLDING = _folding()
_FOLD_FROM, _FOLD_TO = "".join(_FOLDING), "".join(_FOLDING.values())


def clean_text(c: Column) -> Column:
    """Drop soft hyphens and control characters, make each whitespace run one space, trim."""
    kept = F.regexp_replace(c, f"[{STRIP}]", "")
    return F.trim(F.regexp_replace(kept, f"[{WHITESPACE}]+", " "))


def is_blank(c: Column) -> Column:
    """Null, empty or nothing but whitespace."""
    return F.coalesce(~F.regexp_like(c, F.lit(f"[^{BLANK}]")), F.lit(True))


def case_fold(c: Column) -> Column:
    """Case-insensitive form with the same number of characters."""
    return F.lower(F.translate(c, _FOLD_FROM, _FOLD_TO))


def passage_pattern(cleaned: Column) -> Column:
    """Regex that finds cleaned text in raw text, whatever was stripped or collapsed in between."""
    letters = F.regexp_replace(cleaned, "[^ ]", rf"\\Q$0\\E[{_escaped(STRIP)}]*")
    gaps = rf"[{_escaped(WHITESPACE)}][{_escaped(STRIP + WHITESPACE)}]*"
    return F.concat(F.regexp_replace(letters, " ", gaps), F.lit(rf"(?:[{STRIP}{WHITESPACE}]*\z)?"))


def _escaped(pattern: str) -> str:
    return pattern.replace("\\", "\\\\")


def normalize_color(c: Column) -> Column:
    """`#FF0` and `ffff00` are the same colour. Other lengths stay as they are."""
    bare = F.lower(F.ltrim(c, F.lit("#")))
    return F.regexp_replace(bare, "(?s)^(.)(.)(.)$", "$1$1$2$2$3$3")


def normalize_color_name(name: str) -> str:
    bare = name.lstrip("#").lower()
    return "".join(2 * ch for ch in bare) if len(bare) == 3 else bare


def parse_colors(spec: str) -> list[str]:
    """Colours of a comma list. A list without any, or a part such as `#`, is an error."""
    colors = [normalize_color_name(p.strip()) for p in spec.split(",") if p.strip()]
    if not colors or "" in colors:
        raise ValueError(f"invalid colour filter: {spec!r}")
    return sorted(set(colors))


def parse_page_range(spec: str) -> list[tuple[int, int | None]]:
    """`"1,3,5-10,12-"` as 1-based (first, last) pairs; last is None for an open range."""
    spans = []
    for part in (p.strip() for p in spec.split(",")):
        if not part:
            continue
        first, dash, last = part.partition("-")
        low = _page_number(first)
        if not dash:
            spans.append((low, low))
        else:
            spans.append((low, _page_number(last) if last else None))
    return spans


def _page_number(text: str) -> int:
    if not re.fullmatch(r"\s*[+-]?[0-9]+\s*", text) or not -(2**31) <= int(text) < 2**31:
        raise ValueError(f"invalid page number: {text!r}")
    return int(text)


def page_in_range(page_idx: Column, spec: str) -> Column:
    """Whether a 0-based page lies in a 1-based range. A reversed range holds no page.

    The page is compared as it is stored, so that the test can move into the scan.
    """
    spans = [(page_idx >= low - 1) if high is None else page_idx.between(low - 1, high - 1)
             for low, high in parse_page_range(spec)]
    return reduce(Column.__or__, spans) if spans else F.lit(False)


def shown_kind(kind: Column) -> Column:
    """The kind an annotation is shown as: underlines, strikeouts and squiggly lines are highlights."""
    return F.when(kind.isin(*MARKUP_KINDS), F.lit("highlight")).otherwise(kind)


def effective_contents(contents: Column, note_text: Column) -> Column:
    """A note's own contents, else its older text field."""
    return F.when(is_blank(contents), note_text).otherwise(contents)


def label(page_idx: Column, kind: Column | str, state: Column | None = None,
          author: Column | None = None) -> Column:
    """`*(p. 6, note, Accepted, — name)*`; state and author only when given and set."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    parts = [F.concat(F.lit("p. "), (page_idx + 1).cast("string")), kind]
    if state is not None:
        parts.append(F.when(state != "None", state))
    if author is not None:
        parts.append(F.when(~is_blank(author), F.concat(F.lit("— "), author)))
    return F.concat(F.lit("*("), F.concat_ws(", ", *parts), F.lit(")*"))


def file_stem(name: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(name, r"\.[^./]*$", "")
