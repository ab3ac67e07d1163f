"""Rule tables: values only, in the order in which they apply. What depends on the institution is a parameter."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Site:
    """The institution whose pages are processed."""

    name: str = "Tarnbrook State University"
    short: str = "TSU"
    domain: str = "tarnbrook.example"
    street: str = "Mill Drive"
    town: str = "Tarnbrook, Northmoor 10001"
    phone: str = "(555) 555-0100"
    domains: tuple[str, ...] = field(default=())

    @property
    def allowed(self) -> tuple[str, ...]:
        return self.domains or (self.domain,)


DEFAULT_SITE = Site()


def web_boilerplate(site: Site = DEFAULT_SITE) -> list[str]:
    """Boilerplate of web pages. Greedy endings delete to the end of the text."""
    name, short = re.escape(site.name), re.escape(site.short)
    return [
        rf"{short} uses cookies on this website.*",
        r"This website uses cookies!.*?Accept",
        rf"\[!\[Canvas online learning\].*?Search the {short} Site",
        r"\* \[Prospective Students\].*",
        rf"{name}\s+{re.escape(site.street)} \| {re.escape(site.town)}\s+Phone: {re.escape(site.phone)}",
        rf"© \d{{4}} {name}. All rights reserved.",
        r"Connect with us on social media:",
        r"\[Skip to main content\]\(.*?\)",
        r"Toggle navigation",
        r"Enter the search term or name",
        r"↑\s+top",
        r"\[QUICK LINKS\]\(.*?\)",
        r"Loading - JavaScript",
    ]


def pdf_noise(site: Site = DEFAULT_SITE) -> list[str]:
    """Running headers and footers of PDF pages."""
    return [
        rf"{re.escape(site.short)} Catalog \d{{4}}-\d{{4}}",
        re.escape(site.name),
        r"Page \d+ of \d+",
        rf"www\.{re.escape(site.domain)}",
        r"Printed on:.*",
        r"Generated from.*",
        r"\d+\s*$",
    ]


def persona_rules(site: Site = DEFAULT_SITE) -> list[tuple[str, list[str]]]:
    """Personas and the parts of a url that name them; the first match counts."""
    return [
        ("prospective", ["admissions", "apply", "visit", "future-students", "undergraduate-admissions"]),
        ("student", ["current-students", "registrar", "myportal", "canvas", "student-life"]),
        ("faculty", ["faculty", "staff", f"inside.{site.domain}", "faculty-resources"]),
        ("financial", ["tuition", "financial-aid", "bursar", "scholarships", "cost"]),
        ("housing", ["housing", "residence", "dorms", "living-on-campus"]),
    ]


# Words of a question that name a persona; the first match counts.
QUERY_PERSONAS = [
    ("student", ["canvas", "portal", "register", "schedule"]),
    ("faculty", ["teaching", "research", "grants"]),
    ("prospective", ["apply", "tour", "visit", "admissions"]),
]
# Extensions that are not crawled.
IGNORED_EXTENSIONS = ["pdf", "jpg", "jpeg", "png", "gif", "mp4", "avi", "mov", "doc", "docx", "ppt", "pptx", "xls", "xlsx", "zip", "rar", "exe", "css", "js", "xml", "json"]
# Signs of an error page, for merging and for training rows.
ERROR_SIGNS = ["page not found", "404", "error", "not available", "does not exist", "could not be found", "page you requested could not be found"]
TRAINING_ERROR_SIGNS = ["page not found", "404", "error", "not available", "does not exist", "could not be found"]
# Signs of boilerplate in training texts.
TRAINING_BOILERPLATE = ["skip to content", "cookie policy", "toggle navigation", "all rights reserved", "copyright"]
# The quick links that the sample questions are matched with.
QUICK_LINK_KEYWORDS = [
    ("map", ["map", "building", "parking", "location", "directions", "where is"]),
    ("canvas", ["canvas", "login", "portal", "student login", "sign in"]),
    ("tuition", ["tuition", "fafsa", "cost", "financial aid", "payment", "how much"]),
    ("registrar", ["registrar", "registration", "transcript", "grades", "enroll", "get my transcript"]),
    ("calendar", ["calendar", "dates", "deadlines", "semester", "when", "schedule"]),
]
# The chat template of training rows, with its special tokens.
CHAT_TEMPLATE = (
    "<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\n{system}<|eot_id|><|start_header_id|>user<|end_header_id|>\n\n"
    "Context: {context}\nQuestion: {question}<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n<|thought|>\n{thought}\n<|answer|>\n{answer}<|eot_id|>"
)
SYSTEM_PROMPT = "You are a campus assistant. \nUse the provided context to answer questions. Show your reasoning before the final answer."


def pdf_catalogue(site: Site = DEFAULT_SITE) -> list[tuple[str, str, str, str, str]]:
    """Fixed values: (pdf_key, url, title, persona, priority) of the catalogues that are read as PDF."""
    host = f"https://catalog.{site.domain}"
    return [
        ("undergraduate_catalog", f"{host}/content.php?catoid=49&navoid=2687&print", "Undergraduate Catalog 2025-2026", "prospective,student", "critical"),
        ("graduate_catalog", f"{host}/content.php?catoid=50&navoid=2688&print", "Graduate Catalog 2025-2026", "prospective,student", "critical"),
    ]


CHUNK_SIZE, CHUNK_OVERLAP = 500, 50
PDF_CHUNK_SIZE, PDF_CHUNK_OVERLAP = 1000, 100
LEAST_PAGE, LEAST_SECTION, LEAST_PDF_PAGE = 100, 50, 50
TRAINING_LENGTHS = (200, 3000)
SLICE = 50
REQUEST_LENGTHS = (1, 1000)
QUICK_LINK_THRESHOLD = 0.4
