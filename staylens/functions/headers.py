"""Header handling (P1, P2, P4, P5, P8, P12, P15). Column names are metadata:
they are resolved on the driver once per file/table and produce a single
``select`` list; no row ever passes through this module."""

from __future__ import annotations

import re
import unicodedata
from typing import Iterable, Sequence


def _plain(name: object) -> str:
    """Lower-case ASCII letters of a name: accents go, other scripts are dropped."""
    decomposed = unicodedata.normalize("NFKD", str(name))
    return "".join(ch for ch in decomposed if ch.isascii()).lower()


def slug(name: str) -> str:
    """The name's alphanumeric words joined by single underscores."""
    return "_".join(re.findall("[a-z0-9]+", _plain(name)))


def standardize(name: str) -> str:
    """Like :func:`slug`, but existing underscores stay and punctuation at an
    end leaves one underscore there: ``'Sexo  (Desc)'`` -> ``'sexo_desc_'``."""
    return "_".join(re.split(r"\W+", _plain(name).strip()))


def first_existing(columns: Iterable[str], candidates: Sequence[str]) -> str | None:
    """First candidate present among ``columns``."""
    cols = set(columns)
    return next((c for c in candidates if c in cols), None)


def resolve_synonyms(columns: Iterable[str], synonyms: dict[str, Sequence[str]]) -> dict[str, str]:
    """P4 for a whole dictionary: standard name -> first variant present."""
    cols = list(columns)
    out = {}
    for std, variants in synonyms.items():
        hit = first_existing(cols, variants)
        if hit is not None:
            out[std] = hit
    return out


def require(columns: Iterable[str], required: Sequence[str], what: str = "input") -> None:
    """P5: fail before any Spark action when a required column is absent."""
    cols = set(columns)
    missing = [c for c in required if c and c not in cols]
    if missing:
        raise ValueError(f"{what}: missing required columns {missing}")


def align_trailing_underscore(columns: Sequence[str], template: Sequence[str]) -> dict[str, str]:
    """Rename map for names that differ from the template by one trailing '_'
    (a template name with the underscore is preferred to one without)."""
    near = {f"{t}_": t for t in template}
    near.update({t[:-1]: t for t in template if t.endswith("_")})
    return {c: near[c] for c in set(columns) - set(template) if c in near}


def leakage_columns(columns: Sequence[str], patterns: Sequence[str]) -> list[str]:
    """Columns whose name contains any forbidden pattern."""
    return [c for c in columns if any(p in c for p in patterns)]


def whitelist(columns: Sequence[str], allowed: Sequence[str]) -> list[str]:
    """Allowed names that are present, in the allowed order."""
    cols = set(columns)
    return [c for c in allowed if c in cols]
