"""Columns of the catalogue and of its side tables."""

from __future__ import annotations

#: Source columns in file order (fixed values); read and written by position.
SOURCE_FIELDS = [
    "artist", "artist_credit", "title", "title_credit", "matrix_number", "label_number", "label", "country",
    "format", "pressing", "producer", "year", "riddim", "version", "b_side_artist", "b_side_artist_credit",
    "b_side_title", "b_side_title_credit", "b_side_matrix_number", "b_side_label_number", "song_origin", "notes", "genre", "additions",
]
#: Header of each source column in exported files (fixed values).
HEADERS = [
    "Artist", "Artist Credit", "Title", "Title Credit", "Matrix No.", "Label No.", "Label", "Country",
    "Format", "Issue Notes", "Producer", "Year", "Riddim", "Version", "B-Side Artist", "B-Side Artist Credit",
    "B-Side Title", "B-Side Title Credit", "B-Side Matrix No.", "B-Side Label No.", "Song Origin", "Notes", "Genre", "Additions",
]
EDITABLE_FIELDS = [f for f in SOURCE_FIELDS if f != "pressing"]
#: Lower-cased copies: source column -> derived column (fixed values).
NORM_COLUMNS = {
    "artist": "artist_norm", "label": "label_norm", "producer": "producer_norm", "riddim": "riddim_norm",
    "country": "country_norm", "song_origin": "origin_norm", "genre": "genre_norm", "format": "format_norm",
}
DERIVED = ["year_sort", *NORM_COLUMNS.values(), "record_key"]
#: Columns searched by words, and by any substring (fixed values).
PHRASE_FIELDS = ["title", "title_credit", "artist", "artist_credit", "notes"]
SUBSTRING_FIELDS = [
    "artist", "title", "label", "label_number", "matrix_number", "producer", "country", "format", "year", "genre", "riddim", "song_origin", "notes",
    "b_side_artist", "b_side_artist_credit", "b_side_title", "b_side_title_credit", "b_side_matrix_number", "b_side_label_number",
]
#: Columns of a search result, in this order (fixed values).
RESULT_COLUMNS = ["id", "artist", "artist_credit", "title", "title_credit", "label", "label_number", "matrix_number", "country", "year", "format", "riddim", "producer"]
#: Sort key -> column (fixed values).
SORT_COLUMNS = {
    "artist": "artist_norm", "title": "title", "label": "label_norm", "label_number": "label_number", "matrix_number": "matrix_number",
    "country": "country_norm", "year": "year_sort", "format": "format_norm", "riddim": "riddim_norm", "producer": "producer_norm",
}
#: Facet -> (grouped column, shown column, listed whole) (fixed values).
FACETS = {
    "artists": ("artist_norm", "artist", False), "countries": ("country_norm", "country", True), "years": ("year", "year", False),
    "formats": ("format_norm", "format", True), "labels": ("label_norm", "label", False), "producers": ("producer_norm", "producer", False),
    "riddims": ("riddim_norm", "riddim", False), "genres": ("genre_norm", "genre", True), "origins": ("origin_norm", "song_origin", False),
}
B_SIDE_FIELDS = [f for f in SOURCE_FIELDS if f.startswith("b_side_")]

CATALOGUE = ("id long, " + ", ".join(f"{f} string" for f in SOURCE_FIELDS) + ", year_sort int, " + ", ".join(f"{c} string" for c in [*NORM_COLUMNS.values(), "record_key"]))
OVERRIDES = "record_key string, field string, value string, base_value string, has_base boolean, record_label string, record_id long, editor_id long, editor_name string, updated_at timestamp"
ADDED = "id long, record_key string, data string, editor_id long, editor_name string, created_at timestamp, updated_at timestamp"
TOMBSTONES = "record_key string, record_label string, editor_id long, editor_name string, deleted_at timestamp"
LOG = "id long, record_key string, record_id long, action string, field string, old_value string, new_value string, editor_id long, editor_name string, created_at timestamp, reviewed_at timestamp, reviewed_by string, note string, note_at timestamp, note_by string"
