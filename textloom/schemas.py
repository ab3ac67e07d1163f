"""Schemas of records. Sources are always read with one of these, never inferred."""

from __future__ import annotations

SECTION = "title string, section_header string, text string, url string, anchor_url string, anchor_id string, header_level string, persona string, faq_category string, chunk_index int, total_chunks int, page_scraped_at string"
PDF_CHUNK = "title string, section_header string, text string, url string, anchor_url string, anchor_id string, header_level string, source_type string, pdf_page int, total_pages int, chunk_index int, total_chunks_on_page int, persona string, faq_category string, priority string, pdf_key string, pdf_filename string"
COMBINED = SECTION + ", source_type string, pdf_page int, total_pages int, total_chunks_on_page int, priority string, pdf_key string, pdf_filename string"
CHUNK = "chunk_id string, chunk_ix int, document string, url string, anchor_url string, title string, section_header string, persona string, source_type string, header_level string, pdf_page int, embedding array<float>"
RAFT = "question string, oracle string, distractors array<string>, thought_process string, answer string, context string, source_url string, title string, section_header string, persona string, source_type string, pdf_page int"
FAQ = "faq_ix int, category string, url string, title string, description string, keywords array<string>"
PAGE = "url string, html string, markdown string, success boolean, metadata map<string,string>"
PDF_PAGE = "pdf_key string, page_no int, blocks array<struct<type:int,lines:array<struct<spans:array<struct<text:string>>>>>>"
CHAT = "question string, answer string, sources array<map<string,string>>, metadata map<string,string>"
