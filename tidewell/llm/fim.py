"""Fill-in-the-middle: texts cut into prefix, middle and suffix at unit boundaries, and put together in another order.

A unit grammar is a list of boundaries, each a class of characters before it and one after it. Its translation
is a regular expression of no width (a lookbehind and a lookahead for each boundary), at whose places Spark's
``split`` cuts the text: nothing is consumed, so that the pieces joined are the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import distinct_columns

ANY = r"[\s\S]"

#: Boundaries of each kind of unit, as (class before, class after). The units are, as an expression that
#: matches one from left to right (\s: ASCII white space): line ``[^\n]*\n|[^\n]+``, word ``\s*\S+|\s+``, space ``\S*\s+|\S+``, char any.
GRAMMARS: dict[str, list[tuple[str, str]]] = {
    "line": [(r"\n", ANY)],
    "word": [(r"\S", r"\s")],
    "space": [(r"\s", r"\S")],
    "char": [(ANY, ANY)],
}

ADDED = ["n", "form", "prefix", "middle", "suffix", "output"]


def run_grammar(*classes: str) -> list[tuple[str, str]]:
    """The grammar whose units are the longest runs of one class; ``classes`` (their insides, without brackets)
    share no character, and all other characters are one class more."""
    inside = [(f"[{c}]", f"[^{c}]") for c in classes]
    return inside + [(f"[^{''.join(classes)}]", f"[{''.join(classes)}]")]


def boundary(grammar: str | list[tuple[str, str]]) -> str:
    """The expression of no width that matches between two units."""
    pairs = GRAMMARS[grammar] if isinstance(grammar, str) else grammar
    return "|".join(f"(?<={before})(?={after})" for before, after in pairs)


def units(text: Column, grammar: str | list[tuple[str, str]] = "line") -> Column:
    """The units of a text as an array; an empty text, which ``split`` takes for one empty piece, has none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(grammar), -1))


def fill_in_middle(
    documents: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    grammar: str | list[tuple[str, str]] = "line",
    seed: int = 7,
    percent: int = 100,
    spm_percent: int = 50,
    marks: tuple[str, str, str] = ("<P>", "<S>", "<M>"),
    keep: list[str] | None = None,
) -> DataFrame:
    """Adds n (units), form (plain, psm or spm), prefix, middle, suffix (null if plain) and output.

    Cuts and form come from the SHA-256 of ``seed:id``, so that reruns agree. ``percent`` of the texts are
    transformed, of these ``spm_percent`` with the suffix first; a text that holds one of ``marks`` stays plain,
    so that ``restored`` gives every text back. Rows stay where they are: nothing is shuffled or leaves the JVM.
    Edge cases: a null text is empty, and an empty one plain with no units; a null id is an empty one; rows with
    the same id are cut by the same draws; an empty table gives none. Columns that clash in name with an added
    one give way to it.
    """
    names = [c for c in (keep if keep is not None else documents.columns) if c in distinct_columns(documents, ADDED)]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    draw = lambda i: F.conv(F.substring("__h", 8 * i + 1, 8), 16, 10).cast("long")
    whole = F.coalesce(F.col(text), F.lit(""))
    cut = documents.select(*(F.col(f"`{c}`") for c in names), whole.alias("__text"), digest.alias("__h"))
    cut = cut.withColumn("__units", units(F.col("__text"), grammar)).withColumn("n", F.size("__units").cast("long"))
    marked = F.lit(False)
    for mark in marks:
        marked = marked | F.contains(F.col("__text"), F.lit(mark))
    form = F.when((F.col("__text") == "") | marked | (draw(2) % 100 >= percent), "plain").when(draw(3) % 100 < spm_percent, "spm").otherwise("psm")
    places = [draw(i) % (F.col("n") + 1) for i in (0, 1)]
    cut = cut.withColumns({"form": form, "__from": F.least(*places).cast("int"), "__to": F.greatest(*places).cast("int")})
    made = F.col("form") != "plain"
    piece = lambda at, n: F.when(made, F.array_join(F.slice("__units", at, n), ""))
    first, last, n = F.col("__from"), F.col("__to"), F.size("__units")
    cut = cut.withColumns({"prefix": piece(F.lit(1), first), "middle": piece(first + 1, last - first), "suffix": piece(last + 1, n - last)})
    p, s, m = marks
    psm = F.concat(F.lit(p), "prefix", F.lit(s), "suffix", F.lit(m), "middle")
    spm = F.concat(F.lit(s), "suffix", F.lit(p), "prefix", F.lit(m), "middle")
    output = F.when(~made, F.col("__text")).when(F.col("form") == "psm", psm).otherwise(spm)
    return cut.withColumn("output", output).select(*names, *ADDED)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = ("<P>", "<S>", "<M>")) -> Column:
    """The text that an output of that form was made of.

    The first occurrence of a mark is its own: pieces hold none, and none can begin in a piece and end in a mark.
    """
    p, s, m = marks
    rest = lambda whole, at: F.substr(whole, at + 1)

    def pieces(first: str, second: str) -> tuple[Column, Column, Column]:
        body = rest(output, F.lit(len(first)))
        one = F.substring_index(body, second, 1)
        body = rest(body, F.length(one) + len(second))
        two = F.substring_index(body, m, 1)
        return one, two, rest(body, F.length(two) + len(m))

    prefix, suffix, middle = pieces(p, s)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = pieces(s, p)
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(F.concat(prefix, middle, suffix))
