"""Column expressions on text: normalisation, tokens, n-grams, names, paths and previews.

White space is the class [ \\t\\n\\r\\f] in every expression, so that other engines give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from doclens.functions.stopwords import STOP_WORDS

WHITE = r"[ \t\n\r\f]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{WHITE}+|{WHITE}+$", "")


def tokens(text: Column) -> Column:
    """Words of the lower-cased text from which everything but a-z and white space is deleted (not replaced): those of two letters
    or more that are no stop words, in order. Null or blank text has none. Stop words are looked up in a hash set."""
    letters = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z \t\n\r\f]+", "")
    return F.filter(F.split(letters, rf"{WHITE}+"), lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS))


def normalize(text: Column) -> Column:
    return F.array_join(tokens(text), " ")


def word_pattern_tokens(text: Column) -> Column:
    """Runs of two or more ASCII word characters of the lower-cased text, as the usual vectoriser pattern takes them."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9_][a-z0-9_]+)"), 1)


def ngrams(words: Column, low: int = 1, high: int = 2) -> Column:
    """All contiguous n-grams, low to high, joined by a space. Those of n words are those of n - 1 words with the word that follows each."""
    tail = lambda a, n: F.slice(a, n, F.greatest(F.size(a) - n + 1, F.lit(0)))
    grams, out = words, [words] if low == 1 else []
    for n in range(2, high + 1):
        head = F.slice(grams, 1, F.greatest(F.size(grams) - 1, F.lit(0)))
        grams = F.zip_with(head, tail(words, n), lambda a, b: F.concat(a, F.lit(" "), b))
        if n >= low:
            out.append(grams)
    return out[0] if len(out) == 1 else F.concat(*out)


def preview(text: Column, n: int = 200) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def display_text(text: Column, n: int = 400) -> Column:
    # fixed value: the mark of a shortened text
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("\n...(truncado)"))).otherwise(text)


def safe_name(name: Column) -> Column:
    """Runs of other characters than letters, digits, _ and - become _; outer _ go; lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(name, "[^a-zA-Z0-9_-]+", "_"), "^_+|_+$", ""))


def title_name(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


#: The signs of the basic plane that scripts' messages use, and the sign that asks for their coloured form.
SIGNS = "\u23f3\u2705\u26a0\u274c\u2714\ufe0f"


def strip_astral(text: Column) -> Column:
    """Without the characters beyond the basic plane (emoji among them) and without SIGNS."""
    return F.regexp_replace(text, rf"[\x{{10000}}-\x{{10FFFF}}{SIGNS}]", "")


def numbered_file(class_name: Column, n: Column, digits: int = 5, extension: str = "jpg") -> Column:
    return F.format_string(f"%s_%0{digits}d.{extension}", safe_name(class_name), n)


def renamed_file(new_class: Column, old_name: Column) -> Column:
    return F.concat(new_class, F.lit("_"), F.substring_index(old_name, "_", -1))


def class_of_path(path: Column) -> Column:
    """The parent folder's name, for either kind of slash; null where there is none."""
    return F.try_element_at(F.split(F.translate(path, "\\", "/"), "/"), F.lit(-2))


def file_name(path: Column) -> Column:
    return F.substring_index(F.translate(path, "\\", "/"), "/", -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def image_extension(kind: Column, path: Column) -> Column:
    """From the declared format if known, else the path's suffix, else tif."""
    known = F.create_map(*[F.lit(x) for pair in {"jpeg": "jpg", "jpg": "jpg", "png": "png", "tiff": "tif", "tif": "tif", "bmp": "bmp", "gif": "gif"}.items() for x in pair])
    suffix = F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(F.try_element_at(known, F.lower(kind)), F.when(suffix == "tiff", "tif").when(suffix != "", suffix).otherwise("tif"))
