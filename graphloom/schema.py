"""Schemas of the record tables. Ids are dense and follow the component-wise order of paths."""

from __future__ import annotations

RANGE = "struct<start_byte:bigint,end_byte:bigint,start_row:bigint,start_column:bigint,end_row:bigint,end_column:bigint>"

#: Source files as they are read: path and raw bytes.
SOURCES = "path string, content binary"

FILES = f"id bigint, path string, module_name string, language string, content_hash string, byte_len bigint, line_count bigint, has_error boolean, root_range {RANGE}"

#: Element types of the arrays that one extraction pass gives for each file; ids are local to the file.
EXTRACTED = {
    "symbols": f"struct<id:bigint,parent:bigint,is_top_level:boolean,name:string,kind:string,range:{RANGE},name_start:bigint,name_end:bigint,is_async:boolean,decorators:array<string>,docstring:string,returns:string,returns_start:bigint,returns_end:bigint,body_start:bigint,doc_start:bigint,doc_end:bigint>",
    "imports": f"struct<id:bigint,kind:string,module:string,name:string,alias:string,range:{RANGE},name_start:bigint,name_end:bigint>",
    "exports": f"struct<id:bigint,kind:string,name:string,local_name:string,source_module:string,symbol_id:bigint,import_id:bigint,range:{RANGE}>",
    "candidates": f"struct<source:bigint,name:string,qualifier:string,range:{RANGE},is_subclass:boolean,local:bigint>",
    "calls": f"struct<id:bigint,source:bigint,name:string,qualifier:string,range:{RANGE},name_start:bigint,name_end:bigint,arguments:array<struct<pos:bigint,name:string,value:string,start_byte:bigint,end_byte:bigint>>>",
    "parameters": "struct<symbol_id:bigint,pos:bigint,name:string,kind:string,annotation:string,has_default:boolean,start_byte:bigint,end_byte:bigint>",
    "statements": f"struct<id:bigint,parent:bigint,pos:bigint,level:bigint,kind:string,symbol_id:bigint,range:{RANGE}>",
    "bases": "struct<symbol_id:bigint,pos:bigint,name:string,r_start_byte:bigint,r_end_byte:bigint>",
    "members": f"struct<symbol_id:bigint,pos:bigint,name:string,kind:string,annotation:string,value:string,is_optional:boolean,is_static:boolean,range:{RANGE}>",
    "identifiers": "struct<symbol_id:bigint,name:string,role:string,start_byte:bigint,end_byte:bigint>",
    "strings": "struct<symbol_id:bigint,value:string,start_byte:bigint,end_byte:bigint>",
    "tokens": "struct<symbol_id:bigint,group:string,token:string>",
    "jsx_elements": f"struct<id:bigint,parent:bigint,source:bigint,name:string,range:{RANGE},name_start:bigint,name_end:bigint,close_start:bigint,close_end:bigint>",
    "jsx_props": f"struct<element:bigint,pos:bigint,name:string,value:string,value_is_expression:boolean,expression:string,range:{RANGE}>",
    "promise_chains": f"struct<id:bigint,source:bigint,stage_names:array<string>,range:{RANGE},base_start:bigint,base_end:bigint>",
}

PARSED = ", ".join(
    ["path string", "language string", "module_name string", "content_hash string", "byte_len bigint", "line_count bigint", "has_error boolean", f"root_range {RANGE}", "all_names array<string>"]
    + [f"{k} array<{v}>" for k, v in EXTRACTED.items()]
)
