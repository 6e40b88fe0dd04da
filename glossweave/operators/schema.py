"""Schemas of the engine's tables."""

from __future__ import annotations

#: One row an entity of a drawing. space: layout or block; text: the accessors' values in order.
ENTITIES = (
    "doc_id string, space string, container string, entity_ix bigint, dxftype string, text string, tag string,"
    " attribs array<struct<tag:string,text:string>>, cells array<array<string>>, alternatives array<string>, style string"
)
#: Entity types whose text is read, and those whose text is written back.
LEADERS = ("MULTILEADER", "MLEADER", "LEADER")
ATTRIBUTES = ("ATTRIB", "ATTDEF")
INSERTS = ("INSERT", "MINSERT")
TARGETS = ("TEXT", "MTEXT", *ATTRIBUTES, "DIMENSION", *LEADERS, "TABLE")
STYLED = ("TEXT", "MTEXT", *ATTRIBUTES)
