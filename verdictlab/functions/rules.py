"""Rule sets as data: named predicates compiled into one expression per row."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, functions as F

from verdictlab.functions.scalars import LINKBACKS, norm_type, reaction

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
DOTTED_QUAD = r"[0-9]{1,3}(\.[0-9]{1,3}){3}"
PHONE = r"\+?[0-9]{3}[- ][0-9]{3}"
MARKUP = r"\[(url|link|img)[=\]]"
BOTH = ("comment", "linkback")

#: Small words by language, for the bundled detector.
STOP_WORDS = {
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus",
    "en": "the of and to in a is that for it was on are as with at by this be from or an have not they which",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más pero sus",
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce avec sont",
}


@dataclass(frozen=True)
class Rule:
    """``predicate`` makes a boolean Column; a ``final`` rule that matches hides all others."""

    slug: str
    predicate: Callable[[], Column]
    final: bool = False
    reactions: tuple[str, ...] = BOTH
    enabled: bool = True


@dataclass(frozen=True)
class Ruleset:
    rules: tuple[Rule, ...] = field(default=())

    def add(self, slug: str, fn: Callable[[], Column] | str, **kw) -> Ruleset:
        """With a user's rule: a function that makes a Column, or a SQL condition."""
        return replace(self, rules=(*self.rules, Rule(slug, (lambda: F.expr(fn)) if isinstance(fn, str) else fn, **kw)))

    def without(self, slug: str) -> Ruleset:
        return replace(self, rules=tuple(r for r in self.rules if r.slug != slug))

    def from_options(self, options: str | dict) -> Ruleset:
        """The rules that an options document switches on: reaction type -> slug -> "on". ``general`` holds for both
        reaction types. A rule that no reaction type switches on is dropped."""
        on = json.loads(options) if isinstance(options, str) else options
        enabled = lambda kind, slug: on.get(kind, {}).get(slug) in ("on", True, 1)
        kept = []
        for r in self.rules:
            kinds = tuple(k for k in r.reactions if enabled(k, r.slug) or enabled("general", r.slug))
            if kinds:
                kept.append(replace(r, reactions=kinds))
        return Ruleset(tuple(kept))

    def _active(self, final: bool) -> list[tuple[str, Column]]:
        kind = reaction(norm_type(F.col("type")))
        out = []
        for r in self.rules:
            if r.enabled and r.final == final and r.reactions:
                hit = F.coalesce(r.predicate(), F.lit(False))
                out.append((r.slug, hit if set(r.reactions) == set(BOTH) else kind.isin(*r.reactions) & hit))
        return out

    def reason(self) -> Column:
        """The first final rule that matches, else all other matching slugs in order, else null."""
        first = [F.when(c, F.lit(s)) for s, c in self._active(True)]
        rest = [F.when(c, F.lit(s)) for s, c in self._active(False)]
        joined = F.nullif(F.array_join(F.array(*rest), ","), F.lit("")) if rest else F.lit(None).cast("string")
        return F.coalesce(*first, joined)


def front_door(corpus: DataFrame, need_email: bool = False) -> DataFrame:
    """Comments that are accepted at all; the others get no verdict row."""
    ok = F.coalesce(F.col("content"), F.lit("")) != ""
    if need_email:
        ok &= (F.coalesce(F.col("author_email"), F.lit("")) != "") | norm_type(F.col("type")).isin(*LINKBACKS)
    return corpus.filter(ok)


def classify(corpus: DataFrame, ruleset: Ruleset, id_: str = "comment_id", need_email: bool = False) -> DataFrame:
    """``(id, status, reason)`` of every accepted comment: ``spam`` with the rules that matched, else ``1``.

    One projection over the columns that the active rules read: rules are built-in expressions, so the plan is a
    scan, a filter and a project in one codegen stage.
    """
    found = front_door(corpus, need_email).select(F.col(id_).cast("string").alias("id"), ruleset.reason().alias("reason"))
    return found.select("id", F.when(F.col("reason").isNotNull(), "spam").otherwise("1").alias("status"), "reason")


def honeypot(path: Callable[[], Column]) -> Rule:
    """Decoy-field rule: final, from the submission path."""
    return Rule("decoy", lambda: path() == "decoy", final=True)


def regexp(slug: str, pattern: str, column: str = "content", **kw) -> Rule:
    re.compile(pattern)
    return Rule(slug, lambda: F.col(column).rlike(pattern), **kw)


def bbcode(**kw) -> Rule:
    return regexp("bbcode", MARKUP, reactions=("comment",), **kw)


def language(allowed: list[str], min_len: int = 10, column: str = "lang") -> Rule:
    """The text's language isn't among the allowed ones; short texts are let through."""
    return Rule("language", lambda: (F.length("content") >= min_len) & ~F.col(column).isin(*allowed))


def title_is_name(blog: str) -> Rule:
    """A linkback whose author is the blog's own name."""
    return Rule("title_is_name", lambda: F.col("author") == blog, reactions=("linkback",))


def old_rules() -> Ruleset:
    return Ruleset((regexp("r-email", EMAIL),))


def new_rules() -> Ruleset:
    return Ruleset((regexp("r-email", EMAIL), regexp("r-ip", DOTTED_QUAD), regexp("r-phone", PHONE)))


def detect_language(text: Column) -> Column:
    """The language whose small words the text has most of (ties: the first by code; ``und`` without any)."""
    once = lambda x, f: F.transform(F.array(x), f)[0]  # noqa: E731  a lambda's argument is computed once
    # small words have no white space, so empty parts between spaces do no harm
    parts = F.split(F.translate(F.lower(F.coalesce(text, F.lit(""))), "\t\n\x0b\x0c\r", " " * 5), " ")
    listed = {code: sorted(set(own.split())) for code, own in sorted(STOP_WORDS.items())}
    small = F.filter(parts, lambda w: w.isin(*sorted({w for own in listed.values() for w in own})))

    def best(words: Column) -> Column:
        count = lambda own: F.size(F.filter(words, lambda w: w.isin(*own)))
        return F.array_max(F.array(*[F.struct(count(own).alias("n"), F.lit(-no).alias("place"), F.lit(code).alias("code")) for no, (code, own) in enumerate(listed.items())]))

    return once(once(small, best), lambda b: F.when(b["n"] > 0, b["code"]).otherwise("und"))


def bypass(corpus: DataFrame, column: str) -> DataFrame:
    """The corpus with ``column`` emptied: a rule that reads it (the decoy's path, say) can't match, and the others
    show what they would have caught by themselves."""
    return corpus.withColumn(column, F.lit(None).cast(corpus.schema[column].dataType))
