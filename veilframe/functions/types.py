"""Column types and the entity-type filter."""

from __future__ import annotations

from collections.abc import Iterable

from . import fixed_values as fv

SPAN = "struct<start:int,end:int,value:string,type:string,confidence:double,source:string,ord:int>"
ENTRY = "struct<token:string,value:string>"
HIT = "struct<engine:string,label:string,start:int,end:int,score:double>"

CODES = list(fv.ENTITY_TYPES.values())


def parse_types(raw: str | Iterable[str] | None) -> list[str] | None:
    """Type codes named by code or by long name, without repeats; nothing named means all."""
    if not raw:
        return None
    names = raw.split(",") if isinstance(raw, str) else ",".join(raw).split(",")
    known = {code.upper(): code for code in CODES}
    known.update({name.upper(): code for name, code in fv.ENTITY_TYPES.items()})
    wanted = [name.strip().upper() for name in names if name.strip()]
    for name in wanted:
        if name not in known:
            raise ValueError(fv.UNKNOWN_TYPE_ERROR % (name, ", ".join(CODES)))
    return list(dict.fromkeys(known[name] for name in wanted)) or None
