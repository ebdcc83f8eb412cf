"""Text rules of the digest as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that documents, markers, captions and answers are read with.
BULLET_LINE = "^[●•▪▫◦]\\s*$"
BULLET_ITEM = "^[●•▪▫◦]\\s+"
IMAGE_MARKER = "<img\\s+(\\d+)>"
TABLE_BLOCK = "(?s)^<t\\s+\\d+>\\n.*?\\n</t>$"
CAPTION = "(?s)^\\s*(Figure\\s+\\d+[A-Za-z]?\\s*:\\s*.*?)(?=\\n\\n|<img\\s+\\d+>|$)"
CAPTION_PARAGRAPH = "^Figure\\s+\\d+[A-Za-z]?\\s*:"
MISSING_CONTEXT = "no reference passage|no context|context was not provided|no retrieved context|passage is missing|insufficient context"
GROUNDING_EXPOSURE = "retrieved passage|retrieved context|reference passage|retrieval result|retrieval process|rag system|\\brag\\b|faiss|source-grounded|not source-grounded|grounded response|reference-supported|response mode"
REFUSAL = "i cannot answer|i can't answer|i am unable to answer|unable to provide an answer|cannot provide an answer"
NO_CONTEXT = "Insufficient context!"
TABLE_FAILURE = "[table detected but text extraction failed]"
PATTERNS = ("Missing context statement", "Grounding/RAG exposure", "Refusal", "Faultless")

#: A code point that is no character and stands in no text.
MARK = "\ufdd0"


def upper(s: str) -> str:
    """Upper case by single code points, as in SQL: ß becomes ẞ, and what has no capital of one code point stays."""
    one = lambda c: next((u for u in (c.upper(), c.title()) if len(u) == 1), "ẞ" if c == "ß" else c)
    return s.upper() if s.isascii() else "".join(map(one, s))


def strip(c: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")


def newlines(c: Column) -> Column:
    """Line ends as \\n, zero-width spaces deleted."""
    return F.replace(F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), F.lit("\u200b"), F.lit(""))


def normalize_space(c: Column) -> Column:
    c = F.regexp_replace(newlines(c), "[ \\t]+", " ")
    return strip(F.regexp_replace(c, "\\n{3,}", "\n\n"))


def clean_line(c: Column) -> Column:
    return strip(F.regexp_replace(F.replace(c, F.lit("\u200b"), F.lit("")), "[ \\t]+", " "))


def clean_lines(c: Column) -> Column:
    """``clean_line`` for every line of a text at once."""
    c = F.regexp_replace(F.replace(c, F.lit("\u200b"), F.lit("")), "[ \\t]+", " ")
    return F.regexp_replace(c, "(?dmU)^[\\s&&[^\\n]]+|[\\s&&[^\\n]]+$", "")


def is_missing(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def is_bullet_line(c: Column) -> Column:
    return clean_line(c).rlike(BULLET_LINE)


def is_bullet_item(c: Column) -> Column:
    return clean_line(c).rlike(BULLET_ITEM)


def is_table_block(c: Column) -> Column:
    return strip(c).rlike(TABLE_BLOCK)


def is_image_marker(c: Column) -> Column:
    return strip(c).rlike("^<img\\s+\\d+>$")


def repair_bullets(c: Column) -> Column:
    """A bullet alone on a line takes the lines after it, up to an empty line or the next bullet.

    A text of blank lines only is a single newline. Lines grow in one pass over the text: a line break goes where it
    follows such a bullet or a line that has joined one.
    """
    lines = clean_lines(newlines(c))
    text = F.regexp_replace(lines, "(?m)^([●•▪▫◦])(?=\n[●•▪▫◦](?:\n|\\z))", "$1 ")
    text = F.regexp_replace(text, "((?:\\A|(?<=\n))[●•▪▫◦]|(?!\\A)\\G[^\n]+)\n(?=[^\n])(?![●•▪▫◦] ?(?:\n|\\z))", "$1 ")
    text = F.regexp_replace(F.regexp_replace(text, "\\n{3,}", "\n\n"), "^\\n+|\\n+$", "")
    return F.when(~lines.rlike("[^\n]"), F.lit("\n")).otherwise(text)


def protect_markers(c: Column) -> Column:
    """Image markers and table blocks stand as paragraphs of their own."""
    c = F.regexp_replace(c, "\\n*\\s*(<img\\s+\\d+>)\\s*\\n*", "\n\n$1\n\n")
    return F.regexp_replace(c, "(?s)\\n*(<t\\s+\\d+>\\n.*?\\n</t>)\\n*", "\n\n$1\n\n")


def merge_paragraph(c: Column) -> Column:
    """Wrapped lines join by spaces; bullet items, lines before one, and image markers stay lines.

    A line break goes where neither of its lines has to stay. Lines that have to are wrapped in marks first, so a text is
    gone over a few times whatever the number of its lines.
    """
    text = F.regexp_replace(F.regexp_replace(clean_lines(c), "\\n+", "\n"), "^\\n|\\n$", "")
    wrapped = f"{MARK}$1{MARK}"
    text = F.regexp_replace(text, "(?dm)^([●•▪▫◦][\\s&&[^\\n]].*|<img[\\s&&[^\\n]]+\\d+>)$", wrapped)
    text = F.regexp_replace(text, f"(?dm)^([^{MARK}\\n].*)(?=\\n{MARK}[●•▪▫◦])", wrapped)
    merged = F.replace(F.regexp_replace(text, f"(?<!{MARK})\\n(?!{MARK})", " "), F.lit(MARK), F.lit(""))
    return F.when(strip(c) == "", F.lit("")).when(is_image_marker(c) | is_table_block(c), strip(c)).otherwise(merged)


def normalize_passage(c: Column) -> Column:
    """A subsection's raw text as clean paragraphs separated by blank lines."""
    c = F.regexp_replace(newlines(c), "[ \\t]+\\n", "\n")
    c = F.regexp_replace(F.regexp_replace(c, "\\n[ \\t]+", "\n"), "[ \\t]+", " ")
    c = F.regexp_replace(protect_markers(c), "\\n{3,}", "\n\n")
    parts = F.filter(F.transform(F.split(c, "\n\n", -1), merge_paragraph), lambda x: strip(x) != "")
    return strip(F.regexp_replace(F.array_join(parts, "\n\n"), "\\n{3,}", "\n\n"))


def strip_markers(c: Column) -> Column:
    """Passage text for chunking: image markers and table tags go, captions and cells stay."""
    c = F.regexp_replace(c, "<img\\s+\\d+>", "")
    c = F.regexp_replace(F.regexp_replace(c, "<t\\s+\\d+>\\n", ""), "\\n</t>", "")
    return normalize_space(F.regexp_replace(c, "\\n{3,}", "\n\n"))


def caption(after: Column) -> Column:
    """The caption at the start of the text after an image marker, else null."""
    return blank_to_null(F.regexp_extract(after, CAPTION, 1))


def after_caption(after: Column) -> Column:
    return F.regexp_replace(after, CAPTION, "")


def passages(c: Column) -> Column:
    """Paragraphs split on blank lines, stripped, blank ones dropped."""
    return F.filter(F.transform(F.split(c, "\n\n", -1), strip), lambda x: x != "")


def context_list(c: Column) -> Column:
    """Passages of a context; none for null, blank, "nan" or the no-context text."""
    none = c.isNull() | F.lower(strip(c)).isin("", "nan", NO_CONTEXT.lower())
    return F.when(none, F.array().cast("array<string>")).otherwise(passages(c))


def plain_paragraph(c: Column) -> Column:
    """Neither an image marker nor a caption."""
    return ~(strip(c).rlike("^<img\\s+\\d+>$") | strip(c).rlike(CAPTION_PARAGRAPH)) & (strip(c) != "")


def flatten_cells(cells: Column) -> Column:
    """Cells joined by " | ", rows by newlines; null cells are empty, rows that are blank go."""
    rows = F.transform(cells, lambda r: strip(F.array_join(F.transform(r, lambda x: F.coalesce(strip(x), F.lit(""))), " | ")))
    return F.array_join(F.filter(rows, lambda x: x != ""), "\n")


def table_text(cells: Column) -> Column:
    """Flattened cells, or a fixed text where there are none to be had."""
    return F.coalesce(F.nullif(flatten_cells(cells), F.lit("")), F.lit(TABLE_FAILURE))


def subsection_key(header_id: Column, title: Column) -> Column:
    return F.concat(F.lpad(header_id.cast("string"), F.greatest(F.lit(3), F.length(header_id.cast("string"))), F.lit("0")), F.lit("::"), title)


def response_pattern(c: Column) -> Column:
    """First match wins: missing context, exposed grounding, refusal, else faultless."""
    c = F.lower(F.coalesce(c, F.lit("")))
    return F.when(c.rlike(MISSING_CONTEXT), PATTERNS[0]).when(c.rlike(GROUNDING_EXPOSURE), PATTERNS[1]).when(c.rlike(REFUSAL), PATTERNS[2]).otherwise(PATTERNS[3])


def architecture(rag: Column, has_query: Column, has_image: Column) -> Column:
    return F.when(~rag, "SLM").when(has_query & has_image, "Image-Text-RAG").when(has_query, "Text-RAG").when(has_image, "Image-RAG").otherwise("RAG enabled, no retrieval input")


def token_count(c: Column) -> Column:
    """Words and punctuation marks, plus two for the special tokens."""
    return F.size(F.regexp_extract_all(c, F.lit("[a-zA-Z0-9_]+|[^a-zA-Z0-9_ \\n]"), F.lit(0))) + 2
