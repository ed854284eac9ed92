"""Record layouts shared by all stages."""

from __future__ import annotations

CLAIMS = """
  claim_id STRING, original_text STRING, normalized_claim STRING, claim_type STRING,
  citation_need STRING, section STRING, paragraph_id INT, sentence_id INT,
  char_start INT, char_end INT, source_format STRING, split_from_compound BOOLEAN,
  rewrite_permission STRING, queries ARRAY<STRUCT<type:STRING,query:STRING>>,
  search_concepts ARRAY<STRING>, synonyms ARRAY<STRING>, population STRING,
  context STRING, outcome STRING, time STRING, geography STRING
"""

PAPERS = """
  title STRING, authors ARRAY<STRING>, year INT, journal STRING, venue STRING,
  venue_type STRING, doi STRING, url STRING, abstract STRING, citation_count BIGINT,
  volume STRING, issue STRING, pages STRING, publisher STRING, issn_l STRING,
  issn ARRAY<STRING>, open_access_pdf STRING, is_oa BOOLEAN, oa_status STRING,
  language STRING, keywords ARRAY<STRING>, source_layer STRING, source STRING,
  source_apis ARRAY<STRING>, tier_score DOUBLE, recency_score DOUBLE,
  support_score DOUBLE, composite_score DOUBLE
"""

LINKS = """
  claim_id STRING, paper_id STRING, title STRING, doi STRING, support_score DOUBLE,
  support_level STRING, evidence_level STRING, evidence_source STRING,
  evidence_text STRING, selection_status STRING, reason STRING
"""

VERIFICATION_LOG = """
  timestamp STRING, event STRING, paper_id STRING, title_claimed STRING,
  doi_claimed STRING, year_claimed INT, first_author_claimed STRING, verdict STRING,
  details STRUCT<real_title:STRING,real_year:INT,real_first_author:STRING,
    real_authors:ARRAY<STRING>,title_similarity:DOUBLE,year_match:BOOLEAN,
    first_author_match:BOOLEAN,second_source_agree:BOOLEAN,
    conflict_reasons:ARRAY<STRING>,note:STRING,matched_sources:ARRAY<STRING>,
    doi_status:STRING,doi_check:STRUCT<reason:STRING>>
"""

EVIDENCE_LOG = """
  timestamp STRING, event STRING, paper_id STRING, title STRING, doi STRING,
  evidence_level STRING, evidence_source STRING, evidence_chars INT
"""

SUPPORT_LOG = """
  timestamp STRING, event STRING, claim_id STRING, paper_id STRING, title STRING,
  doi STRING, support_score DOUBLE, support_level STRING, evidence_level STRING,
  scoring_method STRING, reasoning STRING
"""

SEARCH_LOG = """
  timestamp STRING, event STRING, paper_id STRING, query STRING, title STRING,
  doi STRING, year INT, venue STRING, first_author STRING, citation_count BIGINT,
  source_apis ARRAY<STRING>
"""

VERDICT_CACHE = """
  doi STRING, verdict STRING, details STRING, authors_backfilled BOOLEAN,
  authors ARRAY<STRING>, cached_at TIMESTAMP
"""

JUDGMENTS = """
  paper_id STRING, support_score DOUBLE, support_level STRING, reasoning STRING
"""

INSERTIONS = """
  paragraph_id INT, sentence_index INT, marker STRING, claim_id STRING,
  paper_id STRING, existing STRING
"""

LATEX_INSERTIONS = """
  section STRING, sentence_index INT, key STRING, claim_id STRING, paper_id STRING
"""

# Raw response layouts of the bibliographic services.
OPENALEX_WORK = """
  id STRING, doi STRING, title STRING, display_name STRING, publication_year INT,
  type STRING, language STRING, cited_by_count BIGINT,
  authorships ARRAY<STRUCT<author:STRUCT<display_name:STRING>>>,
  primary_location STRUCT<source:STRUCT<display_name:STRING,issn_l:STRING,
    issn:ARRAY<STRING>,host_organization_name:STRING>>,
  open_access STRUCT<is_oa:BOOLEAN,oa_status:STRING,oa_url:STRING>,
  biblio STRUCT<volume:STRING,issue:STRING,first_page:STRING,last_page:STRING>,
  abstract_inverted_index MAP<STRING,ARRAY<INT>>
"""

CROSSREF_WORK = """
  DOI STRING, title ARRAY<STRING>, `container-title` ARRAY<STRING>, type STRING,
  author ARRAY<STRUCT<given:STRING,family:STRING,name:STRING>>,
  issued STRUCT<`date-parts`:ARRAY<ARRAY<INT>>>,
  `published-print` STRUCT<`date-parts`:ARRAY<ARRAY<INT>>>,
  `published-online` STRUCT<`date-parts`:ARRAY<ARRAY<INT>>>,
  published STRUCT<`date-parts`:ARRAY<ARRAY<INT>>>,
  abstract STRING, `is-referenced-by-count` BIGINT, volume STRING, issue STRING,
  page STRING, publisher STRING, ISSN ARRAY<STRING>, language STRING,
  subject ARRAY<STRING>
"""

S2_PAPER = """
  paperId STRING, title STRING, year INT, venue STRING, abstract STRING,
  citationCount BIGINT, externalIds STRUCT<DOI:STRING>,
  authors ARRAY<STRUCT<name:STRING>>
"""

POP_RECORD = """
  uid STRING, title STRING, authors ARRAY<STRUCT<name:STRING>>, year INT,
  source STRING, publisher STRING, doi STRING, abstract STRING, volume STRING,
  issue STRING, startpage STRING, endpage STRING, cites BIGINT
"""

EXA_RESULT = """
  title STRING, url STRING, highlight STRING,
  metadata STRUCT<doi:STRING,title:STRING,year:STRING,publishedDate:STRING,
    journal:STRING,venue:STRING,description:STRING,summary:STRING,volume:STRING,
    publisher:STRING,
    authors:ARRAY<STRUCT<first_name:STRING,last_name:STRING>>>
"""

SCHOLAR_RESULT = """
  pub_url STRING,
  bib STRUCT<title:STRING,author:ARRAY<STRING>,pub_year:STRING,venue:STRING,
    doi:STRING,abstract:STRING>
"""
