"""Incremental forms of the batch operators. Windows over events go beyond document processing and are labelled so."""
