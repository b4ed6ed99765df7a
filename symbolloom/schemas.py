"""Fixed values of the data model: schemas, identifiers, weights and display names."""

from __future__ import annotations

# fixed values: categories in the order in which results are emitted
CATEGORIES = ["functions", "methodmaps", "enumstructs", "constants", "defines", "enums", "typesets", "typedefs"]
# fixed values: identifier of a category's symbols, its weight, and the bonus on the symbol's own row
IDENTIFIER = {"functions": "function", "methodmaps": "methodmap", "enumstructs": "enumstruct", "constants": "constant", "defines": "define", "enums": "enumeration", "typesets": "typeset", "typedefs": "typedef"}
WEIGHT = {"functions": 0.02, "methodmaps": 0.05, "enumstructs": 0.05, "enums": 0.03, "typesets": 0.03, "typedefs": 0.03}
OWN_BONUS = {"methodmaps": 0.01, "enumstructs": 0.01, "enums": 0.01}
# fixed values: identifier of a member of a category, by the member's kind
MEMBER_IDENTIFIER = {
    ("methodmaps", "method"): "methodmap_method", ("methodmaps", "property"): "methodmap_property", ("enumstructs", "method"): "enumstruct_method",
    ("enumstructs", "field"): "enumstruct_field", ("enums", "entry"): "enumeration_entry",
}
# fixed values: the identifier under which a member is shown in a path
NORMAL = {"enumeration_entry": "entry", "methodmap_method": "function", "enumstruct_method": "function", "methodmap_property": "property", "enumstruct_field": "field"}
# fixed values: display names
DISPLAY = {"functions": "function", "methodmaps": "methodmap", "enumstructs": "enumstruct", "constants": "constant", "defines": "define", "enums": "enum", "typesets": "typeset", "typedefs": "typedef"}
# fixed values: classes of identifiers and of types
SINGLETON = ["constant", "define", "function", "typedef"]
NESTED = ["methodmap", "enumstruct", "enumeration", "typeset"]
PRIMITIVE_TYPES = ["int", "float", "bool", "char", "any", "void"]
NAME, PARAMETER, RETURN = 0, 1, 2  # parts of a symbol that a search matches

VERSION = "STRUCT<hash STRING, count BIGINT, time BIGINT>"
META = "STRUCT<name STRING, description STRING, author STRING>"
SOURCE = "STRUCT<type STRING, merge BOOLEAN, repository STRING, endpoints ARRAY<STRING>, patterns ARRAY<STRING>>"
ARGUMENTS = "ARRAY<STRUCT<type STRING, name STRING, decl STRING, `default` STRING>>"
DOCS = "STRUCT<brief STRING, tags ARRAY<STRUCT<tag STRING, text STRING>>>"
_DECL = f"name STRING, refLine BIGINT, docStart BIGINT, docEnd BIGINT, docs {DOCS}, metadata STRUCT<created {VERSION}, last_updated {VERSION}>"
_SIGNATURE = f"parsedSignature STRUCT<returnType STRING, arguments {ARGUMENTS}>"
_FUNCTION = f"STRUCT<{_DECL}, kind STRING, returnType STRING, arguments {ARGUMENTS}>"
_MAP = "MAP<STRING, STRUCT<{}>>".format
STRANDS = f"""MAP<STRING, STRUCT<
  functions MAP<STRING, {_FUNCTION}>,
  methodmaps {_MAP(f"{_DECL}, parent STRING, methods MAP<STRING, {_FUNCTION}>, properties {_MAP(_DECL + ', type STRING, getter BOOLEAN, setter BOOLEAN')}")},
  enumstructs {_MAP(f"{_DECL}, methods MAP<STRING, {_FUNCTION}>, fields {_MAP(_DECL + ', type STRING')}")},
  constants {_MAP(_DECL)}, defines {_MAP(_DECL + ", value STRING")}, enums {_MAP(f"{_DECL}, entries {_MAP(_DECL + ', value STRING')}")},
  typesets {_MAP(f"{_DECL}, types {_MAP(_DECL + ', type STRING, ' + _SIGNATURE)}")}, typedefs {_MAP(_DECL + ", type STRING, " + _SIGNATURE)}>>"""
BUNDLE = f"meta {META}, source {SOURCE}, strands {STRANDS}, version {VERSION}"
