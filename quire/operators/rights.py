"""Rights of publications: a right counts only if it is known to be granted."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Right:
    """A nullable boolean column; the reasons to give if it is false, and if it is unknown."""

    column: str
    denied: str
    unknown: str | None = None


def eligible(rights: list[Right]) -> Column:
    """Whether all rights are exactly true; never null."""
    return reduce(lambda a, b: a & b, [granted(F.col(r.column)) for r in rights])


def reasons(rights: list[Right]) -> Column:
    """Why not, in the order of the rights; empty exactly where eligible() holds."""
    return F.array_compact(F.array(*[F.when(F.col(r.column).isNull(), r.unknown or r.denied).when(~F.col(r.column), r.denied) for r in rights]))


def granted(right: Column) -> Column:
    return right.eqNullSafe(F.lit(True))


def same(*keys: Column) -> Column:
    """Whether all keys are known and equal."""
    return F.coalesce(reduce(lambda a, b: a & b, [keys[0] == k for k in keys[1:]]), F.lit(False))


def filled(text: Column) -> Column:
    """Whether a text has more than ASCII white space."""
    return F.coalesce(F.length(F.trim(F.translate(text, "\t\n\r\f\v", ""))) > 0, F.lit(False))


def gate(publication: str = "publication", edition: str = "edition", licence: str = "licence") -> tuple[list[tuple[str, Column]], list[tuple[str, Column]]]:
    """What a publication must fulfil, as (reason if not, condition): always, and where it has a licence record. The arguments name struct columns of a joined row; licence is null where none was found.

    Fixed values: the thirteen reasons, in their order.
    """
    p, e, c = (lambda name, s=s: F.col(f"{s}.{name}") for s in (publication, edition, licence))
    always = [
        ("publication_not_active", same(p("status"), F.lit("active"))),
        ("publication_not_selected", same(e("active_publication_id"), p("id"))),
        ("edition_mismatch", same(p("source_edition_id"), e("id"))),
        ("validation_not_approved", granted(p("validation_approved"))),
        ("not_public", granted(p("public_visibility"))),
        ("license_missing", F.col(licence).isNotNull()),
    ]
    required = c("attribution_required")
    licensed = [
        ("license_mismatch", same(p("license_record_id"), c("id")) & same(c("source_edition_id"), e("id"), p("source_edition_id"))),
        ("rights_not_reviewed", c("reviewer_id").isNotNull() & c("verification_date").isNotNull()),
        ("commercial_use_not_allowed", granted(c("commercial_use_allowed"))),
        ("display_not_allowed", granted(c("display_allowed"))),
        ("redistribution_not_allowed", granted(c("redistribution_allowed"))),
        ("attribution_requirement_unknown", required.isNotNull()),
        ("attribution_missing", ~granted(required) | filled(c("required_attribution_text"))),
    ]
    return always, licensed


def gate_reasons(publication: str = "publication", edition: str = "edition", licence: str = "licence") -> Column:
    """Why a publication isn't eligible, in order; empty if it is."""
    always, licensed = gate(publication, edition, licence)
    found = F.col(licence).isNotNull()
    return F.array_compact(F.array(*[F.when(~ok, code) for code, ok in always], *[F.when(found & ~ok, code) for code, ok in licensed]))


def gate_open(publication: str = "publication", edition: str = "edition", licence: str = "licence") -> Column:
    """Whether it is eligible; the same rows as those without a reason, and never null."""
    always, licensed = gate(publication, edition, licence)
    return reduce(lambda a, b: a & b, [F.coalesce(ok, F.lit(False)) for _, ok in [*always, *licensed]])
