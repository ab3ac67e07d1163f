"""A query per operator over the test tables. Each reads whole tables from sf_dir and returns a DataFrame with flat columns."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.strings import strip
from textloom import schemas
from textloom.operators import chunk, faq, quality, records, retrieval, sections, serving, tags, text, training, urls
from textloom.rules import pdf_catalogue
from textloom.session import cut, scratch_folder
from textloom.sources import readers, writers
from textloom.sources.readers import nth_row, page_range, table
from textloom.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def knn_topk_filtered(spark, sf):
    """The 5 nearest vectors of the first one, among three labels."""
    e = table(spark, sf, "embeddings")
    vector = nth_row(e.where("embedding IS NOT NULL"), "vec_id", 0).first()["embedding"]
    top = retrieval.search_one(e, vector, 5, F.col("label").isin(1, 2, 3))
    return top.select("rank", "vec_id", "label", F.round("distance", 6).alias("distance"))


@query
def knn_batch_topk(spark, sf):
    """The 5 nearest other vectors of every 20th vector."""
    e = table(spark, sf, "embeddings")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.search(asked, e, 5, skip_self=True).select("query_id", F.col("id").alias("vec_id"), "rank", F.round("distance", 6).alias("distance"))


@query
def knn_cells_topk(spark, sf):
    """The same by 16 cells of k-means, as many of them probed as a recall of 0.95 needs on a sample; approximate."""
    e = table(spark, sf, "embeddings")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    centres = retrieval.fit_cells(e, 16)
    return retrieval.search_cells(asked, e, centres, 5, retrieval.probes_for(e, centres), skip_self=True).select("query_id", F.col("id").alias("vec_id"), "rank")


@query
def persona_search_rows(spark, sf):
    """Rows that may answer a student, in both modes."""
    c = table(spark, sf, "combined_campus_data")
    return c.agg(F.count_if(tags.persona_allows(F.col("persona"), "student")).alias("exact_rows"), F.count_if(tags.persona_allows(F.col("persona"), "student", "split")).alias("split_rows"), F.count_if(tags.persona_allows(F.col("persona"), "all")).alias("all_rows"))


@query
def chunk_fixed_rows(spark, sf):
    """Fixed windows of documents."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    return chunk.explode_chunks(d, chunk.fixed_chunks(F.col("text"))).select("doc_id", "chunk_index", "total_chunks", "chunk")


@query
def chunk_fixed_stats(spark, sf):
    """Windows and their code points per language of documents."""
    d = table(spark, sf, "documents").select("lang", "text")
    c = chunk.explode_chunks(d, chunk.gated_chunks(F.col("text"))).where("chunk IS NOT NULL")
    return c.groupBy("lang").agg(F.count("*").alias("chunks"), F.sum(F.length("chunk")).alias("chars"))


@query
def chunk_boundary_rows(spark, sf):
    """Sentence-bound windows of PDF texts."""
    p = table(spark, sf, "campus_pdfs").select("rec_id", "text")
    return chunk.explode_chunks(p, chunk.boundary_chunks(F.col("text"))).select("rec_id", F.col("chunk_index").alias("ix"), "chunk")


@query
def stream_slices(spark, sf):
    """Answers in slices of 50."""
    c = table(spark, sf, "chat_log").select("chat_id", "answer")
    return chunk.explode_chunks(c, chunk.slices(F.col("answer"))).select("chat_id", F.col("chunk_index").alias("ix"), "chunk")


@query
def stream_event_rows(spark, sf):
    """Events that a stream of each answer sends."""
    return serving.stream_events(table(spark, sf, "chat_log"), "chat_id", "answer").select(F.col("id").alias("chat_id"), "seq", "event", "data")


@query
def adjacent_dedup(spark, sf):
    """Texts without blank and repeated neighbouring lines."""
    return table(spark, sf, "combined_campus_data").select("rec_id", text.normalise_lines(F.col("text")).alias("clean"))


@query
def clean_web_text(spark, sf):
    """Web texts without boilerplate, lines normalised."""
    c = table(spark, sf, "combined_campus_data").where("source_type IS NULL OR source_type <> 'pdf'")
    return c.select("rec_id", text.clean_web(F.col("text")).alias("clean"))


@query
def clean_pdf_text(spark, sf):
    """PDF texts without noise."""
    return table(spark, sf, "campus_pdfs").select("rec_id", text.clean_pdf(F.col("text")).alias("clean"))


@query
def page_text_rows(spark, sf):
    """Texts put into layout trees, two lines a block, and read back as page text."""
    lines = F.filter(F.split("text", "\n", -1), lambda x: x != "")
    blocks = F.transform(lines, lambda x, i: F.struct((i % 2).cast("int").alias("type"), F.array(F.struct(F.array(F.struct(x.alias("text"))).alias("spans"))).alias("lines")))
    return table(spark, sf, "campus_pdfs").where("text IS NOT NULL").select("rec_id", text.page_text(blocks).alias("page_text"))


@query
def header_anchor_rows(spark, sf):
    """Headers with ids of crawled pages."""
    p = table(spark, sf, "crawl_pages").select("page_id", F.posexplode(sections.header_anchors("html", "url")).alias("ix", "a"))
    return p.select("page_id", "ix", "a.anchor_id", "a.header_text", "a.anchor_url", "a.level")


@query
def section_split(spark, sf):
    """Sections of crawled pages."""
    p = table(spark, sf, "crawl_pages").select("page_id", "url", "markdown", sections.header_anchors("html", "url").alias("anchors"))
    rows = sections.section_rows(p, sections.sections(F.col("markdown"), F.col("anchors"), F.col("url")))
    return rows.select("page_id", "chunk_index", "total_chunks", "section_header", "section_content", "anchor_id", "anchor_url", "header_level")


@query
def web_section_records(spark, sf):
    """Whole section records of crawled pages."""
    return records.web_sections(table(spark, sf, "crawl_pages"), table(spark, sf, "faq_links"))


@query
def pdf_chunk_records(spark, sf):
    """Whole chunk records of PDF pages."""
    p = table(spark, sf, "campus_pdfs").withColumn("page_no", F.col("pdf_page") - 1)
    return records.pdf_chunks(p.select("rec_id", "pdf_key", "url", "title", "persona", "priority", "pdf_filename", "total_pages", "page_no", "text")).drop("header_level", "faq_category")


@query
def index_chunk_rows(spark, sf):
    """Chunks for the index, with metadata and keys."""
    return records.index_chunks(table(spark, sf, "combined_campus_data"))


@query
def corpus_union(spark, sf):
    """Web records and PDF records as one corpus, error pages left out: records per type."""
    web = table(spark, sf, "combined_campus_data").where("source_type IS NULL OR source_type <> 'pdf'").drop("source_type", "pdf_page")
    both = records.combine(web, table(spark, sf, "campus_pdfs"))
    return both.groupBy(F.coalesce("source_type", F.lit("web")).alias("kind")).agg(F.count("*").alias("n"), F.count("pdf_page").alias("with_page"), F.count("page_scraped_at").alias("with_time"))


@query
def merge_stats(spark, sf):
    """Kept and filtered records per source type."""
    return quality.merge_counts(table(spark, sf, "combined_campus_data").withColumn("source", F.coalesce("source_type", F.lit("web"))))


@query
def error_page_split(spark, sf):
    """Each record with its error-page flag."""
    return table(spark, sf, "combined_campus_data").select("rec_id", quality.error_page(F.col("title"), F.col("text")).alias("is_error"))


@query
def train_eligible(spark, sf):
    """Records that may become training rows."""
    return table(spark, sf, "combined_campus_data").where(quality.training_eligible(F.col("title"), F.col("text"))).select("rec_id")


@query
def dataset_profile(spark, sf):
    """Analysis before generating training rows."""
    return quality.dataset_profile(table(spark, sf, "combined_campus_data"))


@query
def source_counts(spark, sf):
    """Records by source type."""
    return quality.source_counts(table(spark, sf, "combined_campus_data"))


@query
def ingest_counts(spark, sf):
    """Records with text, PDF and others."""
    return quality.ingest_counts(table(spark, sf, "combined_campus_data"))


@query
def crawl_counters(spark, sf):
    """Pages fetched and failed."""
    return quality.crawl_counters(table(spark, sf, "crawl_pages"))


@query
def coverage_by_persona(spark, sf):
    """Records, urls, copies and quick links per persona."""
    return quality.coverage(table(spark, sf, "combined_campus_data"))


@query
def length_gates(spark, sf):
    """Records that pass each length gate."""
    c = table(spark, sf, "combined_campus_data")
    t = F.col("text")
    return c.agg(F.count_if(quality.page_long_enough(t)).alias("pages"), F.count_if(quality.pdf_page_long_enough(t)).alias("pdf_pages"), F.count_if(quality.has_text(t)).alias("with_text"))


@query
def persona_tag(spark, sf):
    """Persona of each record's url."""
    return table(spark, sf, "combined_campus_data").select("rec_id", tags.persona(F.col("url")).alias("tag"))


@query
def faq_page_tag(spark, sf):
    """Quick-link category of each crawled page."""
    c = table(spark, sf, "combined_campus_data").select("rec_id", "url")
    return tags.quick_link_category(c, table(spark, sf, "faq_links")).select("rec_id", F.col("faq_category").alias("category"))


@query
def question_persona(spark, sf):
    """Persona that a question names."""
    return table(spark, sf, "chat_log").select("chat_id", tags.query_persona(F.col("question")).alias("tag"))


@query
def url_admission(spark, sf):
    """Which urls may be crawled, and their parts."""
    c = table(spark, sf, "combined_campus_data")
    return c.select("rec_id", urls.admitted(F.col("anchor_url")).alias("admitted"), urls.authority(F.col("anchor_url")).alias("authority"), urls.defragment(F.col("anchor_url")).alias("page_url"))


@query
def pdf_deep_links(spark, sf):
    """Deep links of PDF pages."""
    p = table(spark, sf, "campus_pdfs")
    return p.select("rec_id", urls.page_link(F.col("url"), F.col("pdf_page")).alias("link"), F.concat(F.lit("Page "), F.col("pdf_page")).alias("header"), F.concat(F.lit("page-"), F.col("pdf_page")).alias("anchor"))


@query
def link_edges(spark, sf):
    """Links of crawled pages as written."""
    p = table(spark, sf, "crawl_pages").select("page_id", F.posexplode(urls.hrefs(F.col("html"))).alias("ix", "href"))
    return p.select("page_id", "ix", "href", urls.defragment(F.col("href")).alias("target"))


@query
def link_targets(spark, sf):
    """Links of crawled pages, absolute."""
    return urls.links(table(spark, sf, "crawl_pages")).select(F.col("id").alias("page_id"), "link_ix", "target")


def _hosts(spark, sf):
    host = lambda c: F.lower(urls.authority(c))
    p = table(spark, sf, "crawl_pages").select("page_id", "url", F.explode(urls.hrefs(F.col("html"))).alias("href"))
    return p.select(host(F.col("url")).alias("src"), host(F.col("href")).alias("dst")).where("src <> '' AND dst <> ''")


@query
def crawl_reach(spark, sf):
    """Hosts reached from the hosts of the first three pages over links, with their depth."""
    seeds = table(spark, sf, "crawl_pages").where("page_id <= 3").select(F.lower(urls.authority(F.col("url"))).alias("url")).where("url <> ''")
    return urls.reachable(_hosts(spark, sf), seeds)


@query
def new_links(spark, sf):
    """Targets of links that no crawled page has as its url."""
    p = table(spark, sf, "crawl_pages")
    found = p.select(F.explode(urls.hrefs(F.col("html"))).alias("href")).select(urls.defragment(F.col("href")).alias("url")).distinct()
    return found.join(p.select(urls.defragment(F.col("url")).alias("url")).distinct(), "url", "left_anti")


@query
def faq_match(spark, sf):
    """Questions that match a quick link."""
    m = faq.match(table(spark, sf, "chat_log").select("chat_id", "question"), table(spark, sf, "faq_links"))
    return m.select("chat_id", "category", "keyword", F.round("confidence", 6).alias("confidence"))


@query
def faq_answers(spark, sf):
    """Answers with quick links."""
    links = table(spark, sf, "faq_links")
    m = faq.match(table(spark, sf, "chat_log").select("chat_id", "question"), links)
    joined = m.join(links.select("category", "url", "title", "description"), "category")
    return joined.select("chat_id", faq.answer(F.col("description"), F.col("title"), F.col("url"), F.col("confidence")).alias("answer"))


@query
def question_similarity(spark, sf):
    """Similarity of question and answer."""
    return table(spark, sf, "chat_log").select("chat_id", F.round(faq.similarity("question", "answer"), 6).alias("ratio"))


@query
def source_extract(spark, sf):
    """Sources of texts with urls."""
    c = table(spark, sf, "combined_campus_data").where("text LIKE '%http%'").select("rec_id", F.posexplode(serving.sources(F.col("text"))).alias("ix", "s"))
    return c.select("rec_id", "ix", "s.url", "s.title")


@query
def hit_format(spark, sf):
    """The 5 nearest documents of every 20th vector as one text, in the order of their ranks."""
    e = table(spark, sf, "embeddings")
    near = retrieval.search(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e)
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "title", "source", "url", "text")
    t = retrieval.hit_text(F.col("title"), F.col("source"), F.lit("web"), F.lit(0), F.col("url"), F.col("text"))
    return retrieval.joined_hits(near.join(d, "id").withColumn("t", t), "query_id", "rank", "t")


@query
def cite_links(spark, sf):
    """Records as markdown citations."""
    return table(spark, sf, "combined_campus_data").select("rec_id", retrieval.citation(F.col("title"), F.col("section_header"), F.col("anchor_url"), F.col("url")).alias("link"))


def _store(spark, sf):
    d = table(spark, sf, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), "text")
    return d.join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), "id")


@query
def hard_negative_rows(spark, sf):
    """Distractors of every 20th stored document."""
    s = _store(spark, sf)
    asked = s.where("id % 20 = 0").select(F.col("id").alias("oracle_id"), "text", "embedding")
    n = training.hard_negatives(asked, s)
    return n.select("oracle_id", F.posexplode("distractors").alias("ix", "doc"))


@query
def generation_prompts(spark, sf):
    """Headers and distractor blocks of the prompts of training rows."""
    r = table(spark, sf, "raft_dataset")
    header = training.context_header(F.col("title"), F.col("section_header"), F.col("source_type"), F.col("pdf_page"), F.col("persona"))
    return r.select("raft_id", header.alias("header"), training.distractor_text(F.col("distractors")).alias("block"))


@query
def generation_prompt_length(spark, sf):
    """Whole prompts of training rows: their lengths."""
    r = table(spark, sf, "raft_dataset")
    header = training.context_header(F.col("title"), F.col("section_header"), F.col("source_type"), F.col("pdf_page"), F.col("persona"))
    return r.select("raft_id", F.length(training.generation_prompt(header, F.col("oracle"), F.col("distractors"), F.col("persona"))).alias("chars"))


@query
def parse_outputs(spark, sf):
    """Generated rows as fenced JSON, parsed back; every tenth is cut short and gives null."""
    r = table(spark, sf, "raft_dataset")
    body = F.concat(F.lit("```json\n"), F.to_json(F.struct("question", "thought_process", "answer"), {"ignoreNullFields": "false"}), F.lit("\n```"))
    out = r.select("raft_id", training.parse_generated(F.when(F.col("raft_id") % 10 == 0, F.left(body, F.lit(20))).otherwise(body)).alias("g"))
    return out.select("raft_id", "g.question", "g.thought_process", "g.answer")


@query
def raft_rows(spark, sf):
    """Training rows assembled from records and generated text."""
    r = table(spark, sf, "raft_dataset").select("raft_id", F.col("oracle").alias("text"), "distractors", F.struct("question", "thought_process", "answer").alias("generated"), F.col("source_url").alias("anchor_url"), F.col("source_url").alias("url"), "title", "section_header", "persona", "source_type", "pdf_page")
    t = training.training_rows(r)
    return t.select("question", "oracle", F.size("distractors").alias("n_distractors"), "thought_process", "answer", "source_url", "title", "section_header", "persona", "source_type", "pdf_page")


@query
def prompt_rows(spark, sf):
    """Training rows in the chat template."""
    r = table(spark, sf, "raft_dataset")
    return r.select("raft_id", training.chat_text(F.col("question"), F.col("oracle"), F.col("distractors"), F.col("thought_process"), F.col("answer")).alias("text"))


@query
def context_lists(spark, sf):
    """Oracle and distractors as one list."""
    r = table(spark, sf, "raft_dataset").where("distractors IS NOT NULL")
    return r.select("raft_id", F.posexplode(F.concat(F.array("oracle"), "distractors")).alias("ix", "doc"))


@query
def request_rows(spark, sf):
    """Valid requests with stripped questions."""
    return records.requests(table(spark, sf, "chat_log").select("chat_id", "question"))


@query
def response_metadata(spark, sf):
    """Response metadata with the elapsed seconds."""
    c = table(spark, sf, "chat_log")
    seconds = (F.col("chat_id") % 1000) / 300
    return c.select("chat_id", F.explode(serving.with_elapsed(F.col("metadata"), seconds)).alias("key", "value"))


@query
def session_questions(spark, sf):
    """Questions of each session before its first exit word."""
    c = table(spark, sf, "chat_log").where("question IS NOT NULL")
    return serving.until_exit(c.select("chat_id", "session_key", "question"), "session_key", "chat_id").select("chat_id")


@query
def page_numbers(spark, sf):
    """A row per page of each PDF."""
    p = table(spark, sf, "campus_pdfs").groupBy("pdf_key").agg(F.max("total_pages").alias("page_count"))
    return page_range(p).select("pdf_key", "page_no")


@query
def answered_questions(spark, sf):
    """Every 20th question answered by a quick link or by the nearest chunks, with hashed embeddings."""
    asked = table(spark, sf, "chat_log").where("chat_id % 20 = 0 AND question IS NOT NULL").select(F.col("chat_id").alias("query_id"), "question")
    links = table(spark, sf, "faq_links")
    quick = faq.match(asked, links).join(links.select("category", "url", "title", "description"), "category")
    quick = quick.select("query_id", faq.answer(F.col("description"), F.col("title"), F.col("url"), F.col("confidence")).alias("answer"))
    index = retrieval.with_embeddings(records.index_chunks(table(spark, sf, "combined_campus_data")), "document")
    return retrieval.answered(asked, index, quick)


@query
def stripped_titles(spark, sf):
    """Titles without white space at the ends, blank ones as "No Title"."""
    c = table(spark, sf, "combined_campus_data")
    t = strip(F.col("title"))
    return c.select("rec_id", F.when(F.coalesce(t, F.lit("")) == "", F.lit("No Title")).otherwise(t).alias("title"))


@query
def streamed_chunks(spark, sf):
    """PDF records chunked by a stream that has seen all files: the same as index chunks of the table."""
    source = f"{sf}/campus_pdfs.parquet"
    folder = scratch_folder(spark, "stream")
    schema = spark.read.parquet(source).schema
    files = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(source if spark.read.parquet(source).inputFiles()[0].rstrip("/").count("campus_pdfs.parquet/") else f"{sf}/campus_pdfs.parque[t]")
    ingest.start_ingest(files, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("chunk_id", "chunk_ix", "document", "url", "pdf_page")


@query
def event_windows(spark, sf):
    """Beyond reference: events per hour and type."""
    return ingest.windowed_counts(table(spark, sf, "events"))


@query
def event_sessions(spark, sf):
    """Beyond reference: sessions of users."""
    return ingest.sessions(table(spark, sf, "events"))


def _stored(pages: DataFrame):
    """A client that serves every url one of the stored pages, chosen by the url's md5."""
    n = pages.count()
    numbered = pages.select("html", "markdown", "success", "metadata", (F.col("page_id") % n).alias("k"))  # ids run from 1 to n

    def fetch(wanted: DataFrame) -> DataFrame:
        k = F.conv(F.left(F.md5("url"), F.lit(8)), 16, 10).cast("long") % n
        return wanted.withColumn("k", k).join(numbered, "k").drop("k")

    return fetch


@query
def crawl_loop(spark, sf):
    """Urls fetched by a crawl from the first three pages until 40 pages had success, with a client that serves stored pages."""
    p = table(spark, sf, "crawl_pages")
    seeds = p.where("page_id <= 3").select("url", F.col("page_id").alias("place"))
    return urls.crawl(seeds, _stored(p), 40).select("url", "success")


@query
def crawl_report(spark, sf):
    """Counters and exit status of a run over the crawled pages."""
    p = table(spark, sf, "crawl_pages")
    return quality.crawl_report(p, records.web_sections(p))


@query
def training_report(spark, sf):
    """Counters of a generation run, with the thoughts as its outputs."""
    return quality.training_report(table(spark, sf, "raft_dataset"), "thought_process")


@query
def persona_knn_topk(spark, sf):
    """The 5 nearest documents of the first vector among those that may answer a student: the filter comes before the ranking."""
    e = table(spark, sf, "embeddings")
    vector = nth_row(e.where("embedding IS NOT NULL"), "vec_id", 0).first()["embedding"]
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "persona").join(e, "vec_id")
    top = retrieval.search_one(d, vector, 5, tags.persona_allows(F.col("persona"), "student"))
    return top.select("rank", "vec_id", "persona", F.round("distance", 6).alias("distance"))


@query
def pdf_hits(spark, sf):
    """PDF records as hits, with their pages."""
    p = table(spark, sf, "campus_pdfs")
    shown = retrieval.hit_text(F.col("title"), F.col("section_header"), F.col("source_type"), F.col("pdf_page"), F.coalesce("anchor_url", "url"), F.col("text"))
    return p.select("rec_id", shown.alias("hit"))


@query
def citation_lists(spark, sf):
    """Sources of answers as lists of citations."""
    cited = F.transform("sources", lambda s: retrieval.citation(s["title"], F.lit(""), s["url"], s["url"]))
    return table(spark, sf, "chat_log").where("size(sources) > 0").select("chat_id", retrieval.citation_list(cited).alias("list"))


@query
def command_prefixes(spark, sf):
    """The first command that a question's first letter completes to."""
    prefix = F.concat(F.lit("/"), F.left(F.lower("question"), F.lit(1)))
    return table(spark, sf, "chat_log").select("chat_id", serving.command(prefix, ["/clone", "/page", "/improve", "/what", "/how", "/where", "/can"]).alias("command"))


@query
def message_histories(spark, sf):
    """Questions as a history, with the answers and their sources appended."""
    c = table(spark, sf, "chat_log")
    asked = c.select("chat_id", F.lit("user").alias("role"), F.col("question").alias("content"))
    given = c.select("chat_id", F.lit("assistant").alias("role"), F.col("answer").alias("content"), "sources")
    return serving.append_messages(asked, given.limit(0)).unionByName(given).select("chat_id", "role", "content", F.coalesce(F.size("sources"), F.lit(0)).alias("n_sources"))


@query
def pdf_catalogue_rows(spark, sf):
    """The static catalogue of PDF files."""
    return spark.createDataFrame(pdf_catalogue(), "pdf_key string, url string, title string, persona string, priority string")


RAFT_COLUMNS = ["question", "oracle", "thought_process", "answer", "source_url", "title", "section_header", "persona", "source_type", "pdf_page"]


def _raft_lines(spark, sf) -> DataFrame:
    r = table(spark, sf, "raft_dataset")
    fields = [F.lit(c) if c not in r.columns else F.col(c) for c in [x.split()[0] for x in schemas.RAFT.split(", ")]]
    return r.select("raft_id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))


@query
def json_strict_rows(spark, sf):
    """Training rows written as JSON lines and read back strictly."""
    folder = scratch_folder(spark, "json")
    r = table(spark, sf, "raft_dataset")
    writers.write_json_lines(r.select("raft_id", "distractors", *RAFT_COLUMNS), folder)
    back = readers.json_lines(spark, folder, "raft_id long, " + schemas.RAFT)
    return back.select("raft_id", *RAFT_COLUMNS, F.size("distractors").alias("n_distractors"))


@query
def json_drop_rows(spark, sf):
    """JSON lines of which every seventh is cut short: the others."""
    folder = scratch_folder(spark, "json")
    lines = _raft_lines(spark, sf)
    lines.select(F.when(F.col("raft_id") % 7 == 0, F.left("value", F.lit(30))).otherwise(F.col("value")).alias("value")).write.text(folder)
    return readers.json_lines(spark, folder, schemas.RAFT, "drop").select("question", "answer", F.size("distractors").alias("n_distractors"))


@query
def json_absent_rows(spark, sf):
    """JSON lines whose anchor_url and persona are absent from every third record and null in every fifth: absent keys are filled."""
    folder = scratch_folder(spark, "json")
    c = table(spark, sf, "combined_campus_data")
    whole = F.struct("rec_id", "url", F.when(F.col("rec_id") % 5 != 0, F.col("anchor_url")).alias("anchor_url"), F.when(F.col("rec_id") % 5 != 0, F.col("persona")).alias("persona"))
    text_ = F.when(F.col("rec_id") % 3 == 0, F.to_json(F.struct("rec_id", "url"), {"ignoreNullFields": "false"})).otherwise(F.to_json(whole, {"ignoreNullFields": "false"}))
    c.select(text_.alias("value")).write.text(folder)
    return readers.json_lines_absent(spark, folder, "rec_id long, url string, anchor_url string, persona string", {"anchor_url": "url"}, {"persona": "all"})


@query
def missing_file_rows(spark, sf):
    """A missing file has no records."""
    return readers.json_lines(spark, f"{sf}/no-such-file.jsonl", schemas.RAFT).select("question", "answer")


@query
def fallback_path_rows(spark, sf):
    """The first of the paths that exists."""
    found = readers.first_existing(spark, [f"{sf}/no-such-file.parquet", f"{sf}/faq_links.parquet"])
    return spark.read.parquet(found).select("faq_ix", "category")


@query
def resumed_rows(spark, sf):
    """A resumed append: half of the questions are stored, then all are offered, and each is stored once."""
    folder = scratch_folder(spark, "json")
    c = table(spark, sf, "chat_log").select("chat_id", "question")
    writers.write_json_lines(c.where("chat_id % 2 = 0"), folder)
    writers.append_new(c, folder, "chat_id", "chat_id long, question string")
    return readers.json_lines(spark, folder, "chat_id long, question string")


@query
def stored_index_rows(spark, sf):
    """PDF chunks of the stored index, read back by partition."""
    folder = scratch_folder(spark, "index")
    writers.write_index(records.index_chunks(table(spark, sf, "combined_campus_data")), folder)
    return spark.read.parquet(folder).where("source_type = 'pdf'").select("chunk_id", "chunk_ix", "document", "pdf_page")


@query
def sitemap_urls(spark, sf):
    """Urls of crawled pages written as sitemap files and read back."""
    folder = scratch_folder(spark, "sitemap")
    table(spark, sf, "crawl_pages").where("url IS NOT NULL").select(F.concat(F.lit("<url><loc>"), "url", F.lit("</loc></url>")).alias("value")).write.text(folder)
    return readers.sitemap(spark, folder)


def _page_client(url: str) -> dict:
    if url.endswith("3"):
        raise OSError("no answer")
    return {"html": f"<p>{url}</p>", "markdown": url, "success": True, "metadata": {"status": 200}}


@query
def fetched_pages(spark, sf):
    """Pages of all urls by a client that fails for some."""
    asked = table(spark, sf, "crawl_pages").where("url IS NOT NULL").select("url").distinct()
    return readers.fetched(spark, asked, _page_client).select("url", "html", "success", F.col("metadata")["status"].alias("status"))


def _pdf_client(url: str) -> bytes:
    if url is None:
        raise ValueError("no url")
    return json.dumps({"title": url, "author": "office", "subject": None, "pages": [[{"type": 0, "lines": [{"spans": [{"text": f"page {k}"}]}]}] for k in range(len(url) % 5 + 1)]}).encode()


def _pdf_files(spark, sf) -> tuple[str, DataFrame]:
    folder = scratch_folder(spark, "pdf")
    files = table(spark, sf, "campus_pdfs").where("pdf_key IS NOT NULL AND url IS NOT NULL").groupBy("pdf_key").agg(F.min("url").alias("url"))
    return folder, cut(readers.downloaded(cut(files), folder, _pdf_client))


@query
def pdf_downloads(spark, sf):
    """PDF files fetched once; a second run finds all of them."""
    folder, first = _pdf_files(spark, sf)
    files = table(spark, sf, "campus_pdfs").where("pdf_key IS NOT NULL AND url IS NOT NULL").groupBy("pdf_key").agg(F.min("url").alias("url"))
    second = readers.downloaded(files, folder, _pdf_client)
    return first.select("key", "ok", F.col("cached").alias("cached_first")).join(second.select("key", F.col("cached").alias("cached_second")), "key")


@query
def pdf_page_rows(spark, sf):
    """Pages and metadata of downloaded PDF files."""
    folder, _ = _pdf_files(spark, sf)
    p = readers.pdf_pages(spark, folder, json.loads)
    return p.select(F.regexp_extract("path", r"([^/]+)\.pdf$", 1).alias("pdf_key"), "page_count", "title", "author", "page_no", text.page_text(F.col("blocks")).alias("page_text"))
