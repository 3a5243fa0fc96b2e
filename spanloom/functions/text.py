"""Text functions as column expressions; all but unescaped() stay in the JVM."""

from __future__ import annotations

import html
from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what stands between the two texts of a twin example in files.
DELIMITER = "###tt9HHSlkWoUM###"
WORD = r"[\p{L}\p{N}]+|[^ \p{L}\p{N}]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cleanup(text: Column | str) -> Column:
    """Line breaks and tabs to spaces, runs of spaces to one, dashes to '-', then a leading 'Abstract' goes; no trim."""
    out = F.regexp_replace(col(text), r"[\r\n\t]", " ")
    out = F.regexp_replace(out, r" +", " ")
    out = F.regexp_replace(out, "[–—‐−]", "-")
    return F.regexp_replace(out, r"^[Aa]bstract", "")


def long_enough(text: Column | str, min_length: int = 80) -> Column:
    """More than min_length characters, before any cleanup."""
    return F.length(col(text)) > min_length


def file_name(doi: Column | str) -> Column:
    return F.translate(col(doi), "/.", "_-")


def strip_html(text: Column | str) -> Column:
    return F.regexp_replace(col(text), r"<[^>]*>", "")


def inner_text(xml: Column | str) -> Column:
    """Text nodes of well-formed XML without a document type; null becomes empty, malformed XML fails."""
    bare = F.regexp_replace(col(xml), r"(?s)<!DOCTYPE[^>\[]*(\[.*?\])?[^>]*>", "")
    return F.coalesce(F.xpath_string(bare, F.lit("string(.)")), F.lit(""))


def part(text: Column | str, separator: str, index: int) -> Column:
    """The index-th part (from 0), or null where there are fewer."""
    quoted = reduce(lambda s, c: s.replace(c, "\\" + c), "\\^$.|?*+()[]{}", separator)
    return F.get(F.split(col(text), quoted), index)


def geneprod(entity_type: Column | str) -> Column:
    """gene and protein become geneprod; other types, geneprod included, stay."""
    return F.regexp_replace(col(entity_type), r"^(gene|protein)$", "geneprod")


def words(text: Column | str, drop_trailing_word: bool = False) -> Column:
    """Runs of letters and digits, and every other character but the space by itself.

    drop_trailing_word leaves out a word that reaches the end of the text.
    """
    out = F.regexp_extract_all(col(text), F.lit(WORD), F.lit(0))
    if drop_trailing_word:
        cut = F.regexp_replace(col(text), r"[\p{L}\p{N}]+\z", "")
        out = F.regexp_extract_all(cut, F.lit(WORD), F.lit(0))
    return out


def natural_key(text: Column | str) -> Column:
    """A key whose string order takes runs of digits as numbers of any length, and all else character by character."""
    parts = F.regexp_extract_all(col(text), F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    bare = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    number = lambda p: F.concat(F.lit("\u0001"), F.lpad(F.length(bare(p)).cast("string"), 10, "0"), bare(p), F.lit("\u0001"))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), number(p)).otherwise(p)), "")


def sentences(text: Column | str) -> Column:
    """Text split after '.', '!' or '?' and white space."""
    marked = F.regexp_replace(F.trim(col(text)), r"([.!?])[ \t\n\f\r]+", "$1\u0001")
    return F.filter(F.split(marked, "\u0001"), lambda s: s != "")


def ascii_fold(text: Column | str) -> Column:
    return F.regexp_replace(col(text), r"[^\x00-\x7F]", "?")


def replace_all(text: Column | str, rules: Sequence[tuple[str, str]]) -> Column:
    """Literal replacements in order."""
    return reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])), rules, col(text))


# What is replaced in texts of panels, in this order, and what marks a text as no caption.
CLEANING = (("’", "'"), ("–", "-"), ("\xa0", " "), ("&amp;", "&"), ("&amp;amp;", "&"), ("&nbsp;", " "), ("\u2009", " "), ("&gt;", ">"), ("&lt;", "<"), ("amp;", ""), (") ", ")"))
POISON = '"button"'
SPACE = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"


def stripped(text: Column | str) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(col(text), rf"^{SPACE}+|{SPACE}+\z", "")


def cleaning_rules(text: Column | str, instead: Column | str = "", rules: Sequence[tuple[str, str]] = CLEANING, poison: str = POISON) -> Column:
    """The text (or what stands instead of one with the poison) without white space at its ends, then replacements in order."""
    other = F.lit(instead) if isinstance(instead, str) else instead
    return replace_all(stripped(F.when(F.contains(col(text), F.lit(poison)), other).otherwise(col(text))), rules)


# How the markup of a caption is mended before and after it is made one sd-panel, in order.
MENDING = (
    (r"(\([^\n]*?\))([\p{L}\p{N}_])", "$1 $2"),
    (r"[\r\n]", ""),
    (r"<br>", "<br/>"),
    (r'(?s)<link href="(.*)">', '<link href="$1"/>'),
    (r'(?s)<link href="(.*)"/>(?:.*(.))?</link>', '<link href="$1">$2</link>'),
    (r"(?s)<\?xml.*?\?>", ""),
)
PANEL = r"(?s)\A<sd-panel>.*</sd-panel>\z"
NESTING = (
    (r"<sd-panel> *(?:<p>)* *<sd-panel>", "<sd-panel>"),
    (r"</sd-panel> *(?:</p>)* *</sd-panel>", "</sd-panel>"),
    (r"<sd-panel/>", ""),
    (r"</sd-panel>\z", " </sd-panel>"),
    (r" +", " "),
)


def panel_caption(caption: Column | str) -> Column:
    """A caption as one sd-panel element: markup mended, line breaks and declarations gone, nested panels made one, spaces single."""
    swap = lambda c, rules: reduce(lambda x, r: F.regexp_replace(x, *r), rules, c)
    out = swap(col(caption), MENDING)
    out = F.when(out.rlike(PANEL), out).otherwise(F.concat(F.lit("<sd-panel>"), out, F.lit("</sd-panel>")))
    return swap(out, NESTING)


def unescaped(text: Column | str) -> Column:
    """Character references as characters, all named and numeric ones of HTML; those of no character become U+FFFD or nothing, as HTML says."""
    decode = F.arrow_udf(lambda column: pa.array([x if x is None or "&" not in x else html.unescape(x) for x in column.to_pylist()], pa.string()), "string")
    return decode(col(text))


# A caption's first sentence after what is no word, and the figure's number in it.
FIRST_SENTENCE = r"\A[^\p{L}\p{N}_]*([^\n\r]*?)[.\r\n]"
FIGURE_NUMBER = r"(?i)fig[.\p{L}\p{N}_\s]+[0-9]"


def figure_title(title: Column | str, caption: Column | str) -> Column:
    """The title, or else the caption's first sentence without markup and figure number, with one dot; empty where no sentence ends."""
    plain = unescaped(strip_html(caption))
    made = F.replace(F.concat(F.regexp_replace(F.regexp_extract(plain, FIRST_SENTENCE, 1), FIGURE_NUMBER, ""), F.lit(".")), F.lit(".."), F.lit("."))
    return F.when(F.coalesce(col(title), F.lit("")) != "", col(title)).when(plain.rlike(FIRST_SENTENCE), made).otherwise("")


def between_tags(text: Column | str, label: str) -> Column:
    """Distinct texts inside '<label> … </label>', in the order found."""
    return F.array_distinct(F.regexp_extract_all(col(text), F.lit(f"<{label}> (.*?) </{label}>"), F.lit(1)))


def prompt(*parts: Column | str) -> Column:
    """Concatenation in which a null is empty."""
    return F.concat(*[F.coalesce(col(p), F.lit("")) for p in parts])


def joined(array: Column | str, separator: str = "///") -> Column:
    return F.array_join(col(array), separator)


def map_text(m: Column | str) -> Column:
    """'k=v, k=v' by key."""
    entries = F.array_sort(F.map_entries(col(m)))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ", ")


def split_name(subset: Column | str) -> Column:
    """train, validation or test for the names in use; null for others."""
    name = F.lower(F.trim(col(subset)))
    return F.when(name.isin("train", "trainset"), "train").when(name.isin("validation", "eval"), "validation").when(name.isin("test", "testset"), "test")


# Keys of supplementary data and of images.
SUPPLEMENT, IMAGE = r"^(.*)_supp_data_(.*)$", r"^(.*)_img_(.*)$"


def log_route(key: Column | str) -> tuple[Column, Column]:
    """Main tag and scalar tag of a logged value's key; an image has no scalar tag."""
    k = col(key)
    group = lambda pattern, n: F.regexp_extract(k, pattern, n)
    image, supplement = k.rlike(IMAGE), k.rlike(SUPPLEMENT)
    loss = k.isin("loss", "eval_loss")
    main = F.when(loss, "losses/main_loss").when(image, F.concat(F.lit("images/"), group(IMAGE, 1), F.lit("_"), group(IMAGE, 2))).when(supplement, F.concat(F.lit("losses/"), group(SUPPLEMENT, 1), F.lit("_supp"))).otherwise(F.concat(F.lit("other_data/"), k))
    scalar = F.when(k == "loss", "train").when(k == "eval_loss", "eval").when(~image & supplement, group(SUPPLEMENT, 2)).when(~image, k)
    return main, scalar


def indented(level: Column | str, text: Column | str) -> Column:
    """A line of a tree rendering."""
    return F.concat(F.repeat(F.lit("  "), col(level).cast("int")), col(text))


def coloured(text: Column | str, predicted: Column | str, truth: Column | str) -> Column:
    """Text in ANSI colours: green where prediction and truth agree on a label, red for a false one, yellow for a missed one."""
    p, t = col(predicted), col(truth)
    code = F.when((p == t) & (t != "O"), "32").when((p != "O") & (p != t), "31").when((p == "O") & (t != "O"), "33")
    return F.when(code.isNull(), col(text)).otherwise(F.concat(F.lit("\u001b["), code, F.lit("m"), col(text), F.lit("\u001b[0m")))
