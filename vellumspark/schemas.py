"""Schemas of the stored tables, as Spark DDL."""

# Field names and types of stored tables, which readers of these know.
SOURCES = "array<struct<ano:int,titulo:string,tipo:string>>"
TASK = f"url string, arquivo string, ano_destino int, fontes {SOURCES}"
MANIFEST = f"url string, local_path string, size_bytes bigint, sha256 string, downloaded_at timestamp, http_status int, ano_destino int, fontes {SOURCES}"
FAILURE = f"url string, error string, http_status int, attempts int, last_attempt_at timestamp, ano_destino int, arquivo string, fontes {SOURCES}"
NODES = "array<struct<type:string,label:string,start:int,end:int,title:string,parent:string>>"
PARSED = (
    "doc_id string, tipo_ato string, year int, filename string, title string, ementa string, processo string, n_pages int, n_chars int, "
    "n_tokens_est int, is_ocr_suspect boolean, pdf_creator string, text string, "
    f"structure {NODES}, tables array<struct<id:string,page:int,markdown:string,rows:int,cols:int>>, footnotes array<struct<num:int,text:string>>"
)
CHUNK = (
    "chunk_id string, doc_id string, tipo_ato string, year int, tier string, section_type string, section_label string, section_parent string, "
    "section_title string, title string, ementa string, filename string, url string, char_start int, char_end int, n_chars int, n_tokens_est int, text string"
)
PAGE = (
    "doc_id string, page int, width double, blocks array<struct<x0:double,y0:double,x1:double,y1:double,text:string,type:int>>, "
    "tables array<array<array<string>>>"
)
GOLDEN = "id string, pergunta string, tipo_query string, resposta_esperada string, docs_relevantes array<string>, tipo_ato_filtro string, year_filtro int"
RECORD = "registros array<struct<titulo:string,pdfs:array<struct<url:string,arquivo:string,tipo:string>>>>"
# Columns of a chunk that a lexical hit, and a stored point, carry.
PAYLOAD_SMALL = ("chunk_id", "doc_id", "tipo_ato", "year", "tier", "section_type", "section_label", "title", "url")
PAYLOAD = (*PAYLOAD_SMALL[:7], "section_parent", "title", "ementa", "filename", "url", "char_start", "char_end", "n_chars", "n_tokens_est")
