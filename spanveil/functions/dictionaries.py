"""Word lists and thresholds.

Everything in this file is a FIXED VALUE: results depend on the exact entries.
Phrases are separated by line ends, words by blanks. Comparison is on the
case-folded form.
"""


def _phrases(block: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(line.strip().lower() for line in block.strip().splitlines()))


def _words(block: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(block.lower().split()))


# Protected regulatory, financial and governance phrases.
PROTECTED_TERMS = _phrases("""
SEBI
SEBI Regulations
Securities and Exchange Board of India
BSE
NSE
Companies Act
Companies (Indian Accounting Standards) Rules
Red Herring Prospectus
Prospectus
IPO
Initial Public Offering
Offer
Offer Price
Offer for Sale
Offer Documents
Offer Proceeds
Objects of the Offer
Book Building Process
Book Running Lead Managers
Registrar
Registrar of Companies
Share Transfer Agents
Ministry of Corporate Affairs
Government of India
Central Government
Corporate Identity Number
CIN
Issue of Capital
Issue Price
Disclosure Requirements
Qualified Institutional Buyers
Retail Individual Investors
Non-Institutional Investors
Anchor Investors
Institutional Investors
Foreign Venture Capital Investors
Reserve Bank of India
Fresh Issue
Bonus Issue
Equity Share
Equity Shares
Shareholders
Shareholder
Investor
Investors
Risk Factors
Financial Statements
Financial Data
Key Financial and Operating Metrics
Adjusted EBITDA
Non-GAAP Financial
Allotment
Allotted
Allottees
Application Forms
ASBA
ASBA Account
ASBA Forms
Retail Portion
Public Offer Account
Share Escrow Agent
Promoter Group
Promoter Selling Shareholders
Individual Promoters
Company Secretary
Board of Directors
Board/ Board of Directors
Audit Committee
CSR Committee
Corporate Social Responsibility Committee
Stakeholders Relationship Committee
Independent Directors
Independent Director
Key Managerial Personnel
Corporate Governance
Certificate of Incorporation
Articles of Association
AoA/Articles of Association
Financial Reporting Standards
International Financial Reporting Standards
Export Promotion Capital Goods
Foreign Exchange Management Regulations
Disclosure
Regulatory Requirements
Regulation S
Schedule XIII
General Information
Definitions and Abbreviations
Offer Structure
Offer Procedure
Basis for Offer Price
Summary Financial Statements
Capital Structure
Material Contracts
Outstanding Litigation
""")

# Public institutions.
PUBLIC_ORGANIZATIONS = _phrases("""
SEBI
Securities and Exchange Board of India
BSE
BSE Limited
National Stock Exchange
National Stock Exchange of India Limited
NSE
Registrar of Companies
RoC
Ministry of Corporate Affairs
MCA
Government of India
Reserve Bank of India
RBI
Income Tax Department
GST Council
Central Electricity Authority
Central Electricity Regulatory Commission
Export Import Bank of India
ICAI
Indian Accounting Standards
Companies Act
SEBI ICDR Regulations
Foreign Exchange Management Act
Securities Contracts (Regulation) Act
""")

# Generic nouns and headings. (A further entry, " auditors" with
# a leading blank, can never equal a stripped value and is therefore left out.)
GENERIC_TERMS = _phrases("""
board
board of directors
company
companies
committee
chairman
managing director
director
directors
promoter
promoters
employee
employees
investor
investors
shareholder
shareholders
issuer
registrar
regulator
issue
offer
offer price
equity share
equity shares
prospectus
risk factors
financial statements
financial data
section
chapter
schedule
rule
regulation
appendix
annexure
table
contents
notes
auditor
banker
bankers
manager
managers
buyers
retail investors
book building process
book running lead managers
qualified institutional buyers
retail individual investors
non-institutional investors
general information
definitions
abbreviations
summary
summary financial statements
offer structure
offer document
offer documents
offer procedure
offer period
bid
bidders
anchor investor
anchor investors
retail portion
non-institutional portion
qib
listing
initial public offering
red herring prospectus
companies act
companies act 2013
our company
corporate office
registered office
contact person
""")

# Words that mark an organisation span as prose.
PROSE_WORDS = _words("""
a an and are as at be being by for from in including namely of on or our
pursuant the their this to was were with whom
""")

# Words that mark a person span as part of an address.
ADDRESS_WORDS = _words("""
apartment colony complex court floor garden house lane marg nagar park pune
road society street tower village
""")

# Role words in person spans (matched anywhere in the value).
ROLE_WORDS = _words("""
chairman director committee officer secretary manager promoter shareholder
investor auditor registrar
""")

# Framing words before an organisation name.
FRAMING_WORDS = _words("our the company promoter promoters shareholder shareholders")

# Words that make a text a legal reference.
LEGAL_REFERENCE_WORDS = _words("section chapter schedule rule regulation article clause")

# Address evidence around an external LOCATION span (+-80 characters).
LOCATION_CONTEXT = _phrases("""
registered office
corporate office
address
village
taluka
district
state
pin
india
""")
LOCATION_RADIUS = 80

# Score thresholds.
DEFAULT_CONFIDENCE = 0.88
SOURCE_THRESHOLDS = {"spacy": 0.92, "presidio": 0.90}
TYPE_THRESHOLDS = {
    "PERSON": 0.92, "ORG": 0.94, "ADDRESS": 0.94, "EMAIL": 0.95, "PHONE": 0.93,
    "IP_ADDRESS": 0.98, "SSN": 0.95, "CREDIT_CARD": 0.95, "DOB": 0.92,
}
SINGLE_WORD_PERSON_SCORE = 0.98
FREQUENCY_LIMIT = 50
FREQUENCY_SCORE = 0.995

# Preference between sources for one and the same span.
SOURCE_RANK = {"regex": 3, "presidio": 2, "spacy": 1}

# Labels of external models and the types they stand for.
NER_LABELS = {"PERSON": "PERSON", "ORG": "ORG"}
NER_SCORE = 0.90
ANALYZER_LABELS = {
    "PERSON": "PERSON", "EMAIL_ADDRESS": "EMAIL", "PHONE_NUMBER": "PHONE",
    "IP_ADDRESS": "IP_ADDRESS", "LOCATION": "ADDRESS", "ORGANIZATION": "ORG",
    "US_SSN": "SSN", "CREDIT_CARD": "CREDIT_CARD",
}
ANALYZER_MIN_SCORE = 0.90

# Verdicts that count as "yes" in a review sheet.
YES_VERDICTS = _words("yes y true 1")

# The entity types.
ENTITY_TYPES = ("PERSON", "EMAIL", "PHONE", "ADDRESS", "ORG", "SSN",
                "CREDIT_CARD", "IP_ADDRESS", "DOB")
