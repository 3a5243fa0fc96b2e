"""Schemas of the data model, fixed by name."""

from __future__ import annotations

ARTICLE = "doi string, title string, journal_name string, pub_date string, pmid string, pmcid string, import_id string, pub_year string, abstract string, nb_figures int, source string"
FIGURE = "paper_doi string, figure_label string, figure_id string, figure_title string, caption string, href string"
PANEL = "paper_doi string, figure_label string, figure_id string, panel_id string, panel_label string, panel_number string, caption string, formatted_caption string, href string, coords string"
TAG = "tag_id string, category string, entity_type string, role string, text string, ext_ids string, norm_text string, ext_dbs string, in_caption boolean, ext_names string, ext_tax_ids string, ext_tax_names string, ext_urls string"
WORDS = "words array<string>, text string, label_ids map<string,array<string>>"
CHARS = "text string, label_ids map<string,array<string>>"
LM = "max_length array<int>, input_ids array<int>, label_ids array<string>, special_tokens_mask array<int>"
LM_TWIN = "max_length array<int>, input_ids array<array<int>>, label_ids array<array<string>>, special_tokens_mask array<array<int>>"
SEQ2SEQ = "subset string, input_text string, output_text string"
PROMPTS = "prompt string, completion string"
BY_NAME = {"article": ARTICLE, "figure": FIGURE, "panel": PANEL, "tag": TAG, "words": WORDS, "chars": CHARS, "lm": LM, "lm_twin": LM_TWIN, "seq2seq": SEQ2SEQ, "prompts": PROMPTS}

REST_ARTICLE = "doi string, title string, journal string, pub_date string, pmid string, pmcid string, year string, nbFigures string"
REST_FIGURE = "figure_id string, label string, fig_title string, caption string, href string, panels array<string>"
REST_TAG = "id string, category string, type string, role string, text string, in_caption string, external_ids array<string>, external_databases array<string>, external_names array<string>, external_tax_ids array<string>, external_tax_names array<string>, external_urls array<string>, normalized_text string"
REST_PANEL = f"current_panel_id string, paper struct<doi:string>, figure struct<label:string,figure_id:string,panels:array<struct<panel_id:string,label:string,panel_number:string,caption:string,formatted_caption:string,href:string,coords:map<string,int>,tags:array<struct<{', '.join(x.replace(' ', ':', 1) for x in REST_TAG.split(', '))}>>>>>"
