"""The schemas of all tables; none is inferred."""

RAW_PAGE = """id string, type string, status string, title string, space struct<key:string>,
version struct<when:string,by:struct<displayName:string>>, ancestors array<struct<title:string>>,
metadata struct<labels:struct<results:array<struct<name:string>>>>, body struct<view:struct<value:string>>,
_links struct<base:string,webui:string>"""
SECTION = "struct<size:int,results:array<string>>"
RESTRICTED = f"restrictions struct<user:{SECTION},group:{SECTION}>, user {SECTION}, `group` {SECTION}"
RESTRICTION = f"page_id string, {RESTRICTED}"
PAGE = """page_id string, space_key string, title string, url string, labels array<string>, author string,
last_modified string, ancestors array<string>, breadcrumb string, body_html string, text string, content_hash string"""
BLOCKS = "array<struct<pos:int,kind:string,text:string,level:int>>"
CHUNK = "page_id string, ordinal int, chunk_id string, breadcrumb string, text string, token_count int, kind string, whole boolean"
POINT = """id string, page_id string, chunk_id string, space_key string, title string, breadcrumb string, url string,
labels array<string>, author string, last_modified string, content_hash string, text string, dense array<float>, n_terms int, terms array<string>, tfs array<int>"""
STATE = "page_id string, content_hash string, last_modified string, space_key string, title string, url string"
QUESTION = "question string, gold_page_ids array<string>"
EVENT = "value string"
