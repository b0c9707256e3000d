"""Quality rules, line first: every line is held against punctuation, navigation and boilerplate rules, failing lines are
removed, and a document that loses too much of its text is rejected. Native: expressions only, no shuffle at all.

Defined cases: a null text counts as one without words; a text without words has no lines and is rejected by the base
rules; repeated rows are judged each for itself; further columns are carried along, those named like a result column are
replaced; lines without words stay in clean_text, so a text that loses no line stays as it is. Windows of three words are told
apart by a 64-bit hash within one text. A line is boilerplate if it has one such phrase for every phrase_words of its words, at
any length.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, GAP, carried, unpacked, whole, words

SYMBOLS = "#*$%&|<>"

#: Wording of licence, rights, cookie and subscription lines, English, German, French and Spanish; a dot stands
#: for a letter with a mark.
BOILERPLATE = (
    r"(?i)licensed under |released under the |is licensed |all rights reserved|copyright (?:\(c\)|©|[0-9]{4})|"
    r"privacy policy|terms of (?:use|service)|accept (?:all )?cookies|uses cookies|click here|"
    r"subscribe to (?:our|the)|sign up for|enable javascript|share this (?:page|article|post)|powered by |"
    r"alle rechte vorbehalten|datenschutzerkl.rung|nutzungsbedingungen|cookies (?:akzeptieren|verwenden)|newsletter abonnieren|"
    r"tous droits r.serv.s|politique de confidentialit.|conditions d.utilisation|accepter les cookies|cliquez ici|"
    r"todos los derechos reservados|pol.tica de privacidad|condiciones de uso|aceptar (?:las )?cookies|haga clic aqu."
)
_PHRASES = BOILERPLATE.removeprefix("(?i)")
_STARTS = zip(*[x[:3] for x in re.split(r"\|(?![^(]*\))", _PHRASES)], strict=True)
#: BOILERPLATE behind a look at three letters, which few places of a text pass; it matches the same.
SCREENED = f"(?i)(?={''.join(f'[{"".join(sorted(set(x)))}]' for x in _STARTS)})(?:{_PHRASES})"
#: Words that a menu line is made of, in the same languages.
MENU = (
    r"(?i)^\W*(?:(?:home|menu|login|log in|register|search|contact|about|sitemap|next|previous|back|top|help|faq|"
    r"startseite|anmelden|suche|kontakt|impressum|hilfe|accueil|connexion|recherche|aide|inicio|buscar|contacto|ayuda)\W*)+$"
)
#: A phrase of boilerplate spoils so many words of its line.
PHRASE_WORDS = 60


def line_verdict(line: Column, phrase_words: int = PHRASE_WORDS) -> Column:
    """Null for a line that stays, else the rule that it fails: punctuation, navigation or boilerplate."""
    return _verdict(F.btrim(line, F.lit(BLANKS)), phrase_words)


def _verdict(bare: Column, phrase_words: int) -> Column:
    n = F.size(F.split(bare, GAP))
    marks = F.regexp_count(bare, F.lit("[#*$%&<>!]"))
    bars = F.regexp_count(bare, F.lit("[|»•›]"))
    ends = F.substring(bare, -1, 1).isin(*".!?…:;,\"')]”»。")
    return (
        F.when((bars >= 3) & (bars * 3 >= n - bars) | bare.rlike(MENU), "navigation")
        .when(F.when(bare.rlike(SCREENED), F.regexp_count(bare, F.lit(SCREENED)) * phrase_words >= n).otherwise(False), "boilerplate")
        .when((marks >= 3) & (marks >= n) | ~ends & (n < 4), "punctuation")
    )


def _repeated(grams: Column, ranked: Column) -> Column:
    """Positions of the windows that occur twice or more: neighbours among the windows sorted by hash."""
    again = F.filter(
        ranked,
        lambda x, i: F.coalesce(F.get(ranked, i + 1)["h"] == x["h"], F.lit(False))
        | ((i > 0) & F.coalesce(F.get(ranked, i - 1)["h"] == x["h"], F.lit(False))),
    )
    return F.transform(again, lambda x: x["i"])


def quality_rules(
    docs: DataFrame,
    text: str = "text",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    min_kept_percent: int = 50,
    phrase_words: int = PHRASE_WORDS,
) -> DataFrame:
    """Every row with the base counts, base_failed, n_lines, n_lines_removed, n_chars_lines, n_chars_kept, clean_text and kept."""
    # replace and patterns here and below, as translate looks each letter up in a table
    def verdict(x: Column) -> Column:
        c = F.length(reduce(lambda a, blank: F.replace(a, F.lit(blank), F.lit("")), BLANKS.replace("\n", ""), x["bare"]))
        return F.struct(F.when(x["bare"] != "", _verdict(x["bare"], phrase_words)).alias("why"), c.alias("c"), x["line"].alias("line"))

    def bared(line: Column) -> Column:
        return F.struct(line.alias("line"), F.btrim(line, F.lit(BLANKS)).alias("bare"))

    out = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines", "n_lines_removed", "n_chars_lines", "n_chars_kept", "clean_text", "kept"]
    d = docs.select(carried(docs, out), whole(F.col(f"`{text}`")).alias("_t"))
    d = d.withColumns({"_w": words(F.col("_t")), "_l": F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")})
    d = d.withColumns(
        {
            "_n": F.size("_w"),
            "_g": F.when(
                F.size("_w") >= 3,
                F.transform(F.slice("_w", 1, F.size("_w") - 2), lambda x, i: F.xxhash64(x, F.get("_w", i + 1), F.get("_w", i + 2))),
            ).otherwise(F.array().cast("array<bigint>")),
            "_v": F.transform(F.transform(F.split("_t", "\n"), bared), verdict),
        }
    )
    d = d.withColumn("_s", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    d = d.withColumn("_p", F.when(F.col("_s").isNotNull(), _repeated(F.col("_g"), F.col("_s"))))
    d = d.withColumn("_k", F.filter("_v", lambda x: x["why"].isNull()))
    chars = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x["c"])
    d = d.select(
        "carried",
        F.col("_n").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.col("_p").isNotNull(),
            F.size(F.array_distinct(F.concat("_p", F.transform("_p", lambda i: i + 1), F.transform("_p", lambda i: i + 2)))),
        ).otherwise(0).cast("long").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_v") - F.size("_k")).cast("long").alias("n_lines_removed"),
        chars(F.col("_v")).alias("n_chars_lines"),
        chars(F.col("_k")).alias("n_chars_kept"),
        F.array_join(F.transform("_k", lambda x: x["line"]), "\n").alias("clean_text"),
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    d = d.withColumn("base_failed", failed)
    d = d.withColumn("kept", ~F.col("base_failed") & (100 * F.col("n_chars_kept") >= min_kept_percent * F.col("n_chars_lines")))
    # a caller's filter is not pushed below this generator, where the whole analysis would be repeated for it
    d = d.select("carried", F.inline(F.array(F.struct(*out))))
    return d.select(*unpacked(docs, out), *out)
