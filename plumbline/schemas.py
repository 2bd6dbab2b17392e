"""Schemas of tables and records, as DDL."""

DOCUMENTS = "doc_id string not null, ticker string not null, company string not null, cik bigint not null, form_type string not null, fiscal_year int not null, filed_date date not null, source_url string not null, raw_chars int not null, ingested_at timestamp"
CHUNKS = "chunk_id bigint not null, doc_id string not null, item_section string, section_title string, chunk_index int not null, token_count int not null, content string not null, embedding array<float>"
MANIFEST = "cik bigint, company string, form_type string, accession string, accession_dashed string, filed_date string, report_date string, document string, fiscal_year int, ticker string, source_url string, doc_id string, local_path string, raw_chars bigint"
SECTION = "item_section string, section_title string, heading_as_found string, content string, char_count int, start int, recovered_from_fpages boolean"
PARSED = f"source_file string, total_chars int, sections_found array<string>, sections_indexed array<string>, item8_recovered_from_fpages boolean, sections array<struct<{SECTION.replace(' string', ': string').replace(' int', ': int').replace(' boolean', ': boolean')}>>"
HIT = "query_id bigint, rank int, chunk_id bigint, score double, semantic_rank int, keyword_rank int"
QUESTION = "id string, question string, type string, answerable boolean, gold_answer string, notes string, gold_chunk_ids array<bigint>, gold_chunks array<struct<doc_id: string, chunk_index: int, contains: string, unlocalisable: struct<anchor: string, reason: string>>>"
GENERATION = "id string, type string, answerable boolean, run int, text string, refused boolean, cited array<int>, problems array<string>, excerpt_ids array<bigint>, gold_chunk_ids array<bigint>, judged array<struct<claim: string, cited: array<int>, verdict: string, raw: string>>"
LATENCY = "retrieval_s double, generation_s double, total_s double, input_tokens int, output_tokens int, excerpts int, refused boolean, type string, question string"
