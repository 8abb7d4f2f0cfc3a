"""Ordered rule tables: (label, pattern); the first found wins, whatever the case. Patterns of facts, phrases and the texts of template sentences. All of these are fixed values, on which results depend."""

DOCUMENT_TYPES = [
    ("title_commitment", "commitment|schedule a"),
    ("deed_of_trust", "deed of trust"),
    ("mortgage", "mortgage"),
    ("grant_deed", "grant deed"),
    ("warranty_deed", r"warranty deed|\bthis deed\b"),
    ("judgment", "judgment"),
    ("tax_certificate", "tax"),
    ("survey", "survey"),
]
REQUIREMENTS = [
    ("payment", "pay.*(amount|premium|fee)|(amount|premium|fee).*pay"),
    ("execution_recordation", "record|deliver|sign"),
    ("release_of_lien", "release|satisf.*mortgage|mortgage.*satisf"),
    ("satisfaction_of_judgment", "judgment"),
    ("death_administration", "death|estate of|administra"),
    ("entity_authority", "authority|good standing|corporate resolution"),
    ("survey", "survey"),
]
ADDRESSEES = [
    ("seller", "seller"),
    ("buyer", "buyer|purchaser"),
    ("lender", "lender|mortgagee"),
    ("title_co", "title agent|underwriter|title insurance company"),
]
EXCEPTIONS = [
    ("tax", "tax|assessment"),
    ("easement", "easement|right of way"),
    ("survey_matter", "encroach|survey"),
    ("mineral_rights", "oil|gas|mineral"),
    ("lease", "lease|tenant"),
    ("restriction", "restrict|covenant"),
    ("lien", "lien|mortgage|judgment"),
    ("standard", r"\bdefects?\b|\badverse claims?\b|\bgap exception\b"),
]
INSTRUMENTS = [
    ("warranty_deed", r"\bwarranty\s+deed\b"),
    ("grant_deed", r"\bgrant\s+deed\b"),
    ("quitclaim_deed", r"\bquitclaim\s+deed\b"),
    ("special_warranty_deed", r"\bspecial\s+warranty\s+deed\b"),
    ("trustees_deed", r"\btrustee'?s?\s+deed\b"),
    ("tax_deed", r"\btax\s+deed\b"),
    ("deed_of_trust", r"\bdeed\s+of\s+trust\b"),
    ("mortgage", r"\bmortgage\b"),
    ("release", r"\b(?:release|satisfaction|reconveyance)\b"),
    ("assignment", r"\bassignment\b"),
    ("affidavit", r"\baffidavit\b"),
    ("court_order", r"\bcourt\s+order|judgment\s+of\s+(?:foreclosure|partition)\b"),
]
LIENS = [
    ("deed_of_trust", r"\bdeed\s+of\s+trust\b"),
    ("mortgage", r"\bmortgage\b"),
    ("mechanics_lien", r"\bmechanic'?s?\s+lien\b"),
    ("irs_lien", r"\bIRS\s+(?:tax\s+)?lien|\bfederal\s+tax\s+lien\b"),
    ("state_tax_lien", r"\bstate\s+tax\s+lien\b"),
    ("tax_lien", r"\btax\s+lien\b"),
    ("judgment_lien", r"\bjudgment\s+lien|\babstract\s+of\s+judgment\b"),
    ("hoa_lien", r"\bHOA\s+(?:lien|assessment)|\bhomeowners?\s+association\s+lien\b"),
    ("ucc_filing", r"\bUCC[-\s]?1\b|\buniform\s+commercial\s+code\b"),
    ("child_support", r"\bchild\s+support\s+lien\b"),
    ("assessment", r"\bspecial\s+assessment\b"),
]
RELEASED = r"\b(?:released|satisfied|paid\s+in\s+full|reconveyed|terminated|cancelled)\b"
EASEMENTS = [
    ("utility", r"\butility\s+easement\b"),
    ("drainage", r"\bdrainage\s+easement\b"),
    ("conservation", r"\bconservation\s+easement\b"),
    ("right_of_way", r"\bright[\s\-]of[\s\-]way\b|\bROW\b"),
    ("ingress_egress", r"\bingress\s+and\s+egress|\bingress[\s/]egress\b"),
    ("access", r"\baccess\s+easement\b"),
    ("party_wall", r"\bparty\s+wall\b"),
    ("other", r"\beasement\b"),
]
EASEMENT_TRIGGER = r"\beasement\b|\bright[\s\-]of[\s\-]way\b|\bingress\s+and\s+egress"
RESTRICTIONS = [
    ("ccr", r"\bCC&?R'?s?\b|\bcovenants?,?\s+conditions?,?\s+and\s+restrictions?\b"),
    ("hoa_declaration", r"\bHOA\s+declaration|\bdeclaration\s+of\s+covenants?\b"),
    ("deed_restriction", r"\bdeed\s+restrictions?\b"),
    ("zoning_overlay", r"\bzoning\s+overlay|\bzoning\s+restriction|\bzoning\s+district\b"),
    ("historic_designation", r"\bhistoric(?:\s+designation|\s+district|\s+landmark)\b"),
]
RESTRICTION_TRIGGER = r"\bCC&?R'?s?\b|\bcovenants?,?\s+conditions?,?\s+and\s+restrictions?\b|\bHOA\s+declaration|\bdeclaration\s+of\s+covenants?\b|\bdeed\s+restrictions?\b|\bzoning\s+overlay|\bzoning\s+restriction|\bhistoric(?:\s+designation|\s+district)\b"
DISCRIMINATORY = r"\b(?:race|color|religion|national\s+origin|familial\s+status|discriminat(?:ory|ion)|deleted\s+pursuant\s+to|fair\s+housing\s+act)\b"
#: A recorded document: groups are book, page and number; a bare dated number has none.
RECORDING = (
    r"(?:Deed\s+Book|Book|Vol(?:ume)?|Liber)\s+([A-Z0-9\-]+)(?:\s+of\s+[A-Z][A-Za-z ]{2,40})?\s*[,;]?\s*(?:at\s+)?(?:Page|Pg\.?|Folio)\s+([A-Z0-9\-]+)"
    r"|(?:Instrument|Document|Doc\.?|Recording|File|Reception)\s+(?:No\.?|Number|#)\s*([A-Z0-9\-/]+)"
    r"|\d{8,}-\d{4,}"
)
#: role, pattern; the order is that of the facts. The second group of the first is a wife.
PARTIES = [
    ("grantor", r"\bby\s+([A-Z][A-Za-z .,&'-]{2,80}?)\s+(?:and wife\s+([A-Z][A-Za-z .'-]{2,60}))?\s+(?:of|to)\b"),
    ("grantee", r"\bto\s+([A-Z][A-Za-z .,&'-]{2,80}?)(?:\s+of|\s*\(|,|\.)"),
    ("borrower", r"\b(?:borrower|trustor|grantor)[:\s]+([A-Z][A-Za-z .,&'-]{2,100})"),
    ("lender", r"\b(?:lender|beneficiary)[:\s]+([A-Z][A-Za-z .,&'-]{2,100})"),
    ("trustee", r"\b(?:trustee)[:\s]+([A-Z][A-Za-z .,&'-]{2,100})"),
    ("owner", r"\bvest(?:ed|ing)?\s+(?:in|owner)[:\s]+([A-Z][A-Za-z .,&'-]{2,100})"),
]
NO_PLACE = r"\b(?:County|State|North Carolina|Virginia|Texas)\b.*$"
ENTITY = r"\b(inc|llc|corp|company|bank|association|department|united states|office)\b"
NO_NAME = r"\b(first page|closing|policy|exception|underwriter|guidelines|satisfaction|facts|alta licensees)\b"
CONVEYED = r"\b(?:by|from)\s+([A-Z][A-Za-z .,&'\-]{2,80})(?:\s+to\s+([A-Z][A-Za-z .,&'\-]{2,80}))?"
IN_FAVOR_OF = r"in\s+favor\s+of\s+([A-Z][A-Za-z .,&'\-]{2,80})"
EXECUTED_BY = r"(?:executed\s+by|from)\s+([A-Z][A-Za-z .,&'\-]{2,80})"
HELD_BY = r"(?:in\s+favor\s+of|granted\s+to|for\s+the\s+benefit\s+of)\s+([A-Z][A-Za-z .,&'\-]{2,80})"
AMOUNT = r"\$\s*([0-9][0-9,]*(?:\.[0-9]{2})?)"
POLICY_AMOUNT = r"(?:Amount\s+of\s+Insurance|Policy\s+Amount|Proposed\s+Policy\s+Amount|Proposed\s+Insurance\s+Amount|Loan\s+Policy\s+Amount|Owner'?s?\s+Policy\s+Amount)[:\s]*\$?\s*([0-9][0-9,]*(?:\.[0-9]{2})?)"
_A_DATE = r"([0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}|[A-Z][a-z]+\s+[0-9]{1,2},\s*[0-9]{4})"
EFFECTIVE_DATE = [rf"(?:Effective|Commitment)\s+Date[:\s]+{_A_DATE}", rf"Date\s+of\s+(?:Policy|Commitment)[:\s]+{_A_DATE}"]
DATE_FORMATS = ("M/d/yyyy", "M-d-yyyy", "yyyy-MM-dd", "MMMM d, yyyy", "MMM d, yyyy")
INSURED = [r"Proposed\s+Insured[:\s]+([A-Z][A-Za-z .,&'-]{2,120})", r"Named\s+Insured[:\s]+([A-Z][A-Za-z .,&'-]{2,120})"]
ESTATE = [
    r"(?:Estate\s+or\s+Interest\s+(?:in\s+the\s+Land\s+)?(?:described\s+(?:in\s+)?(?:this\s+)?(?:Commitment\s+)?is|to\s+be\s+insured\s+(?:is|:))|Title\s+(?:to\s+be\s+insured\s+)?is\s+vested\s+in\s+[^.]{0,80}?\s+as)[^.]{0,60}?(Fee\s+Simple|Leasehold|Easement|Life\s+Estate)",
    r"(?:^|\n)\s*\d+\.\s*(?:The\s+)?(?:estate\s+or\s+interest|Type\s+of\s+(?:Estate|Interest))[^.\n]{0,120}?(Fee\s+Simple|Leasehold|Easement|Life\s+Estate)",
    r"(Fee\s+Simple|Leasehold|Life\s+Estate)\s+(?:interest|estate)\b",
]
ESTATES = [("fee_simple", "fee"), ("leasehold", "lease"), ("easement", "easement"), ("life_estate", "life")]
SCHEDULE_ONE = r"(?:I\.\s+Requirements?|Schedule\s+B\s*[-–]?\s*Section\s+I[^\n]{0,120}|Requirements\s+to\s+Issue\s+Policy)(.{50,12000}?)(?=II\.|Schedule\s+B\s*[-–]?\s*Section\s+II|Standard\s+Exceptions|Schedule\s+C|$)"
SCHEDULE_TWO = r"(?:II\.\s+Exceptions?|Schedule\s+B\s*[-–]?\s*Section\s+II[^\n]{0,200}|Exceptions\s+from\s+Coverage)(.{50,16000}?)(?=Schedule\s+C|Endorsements|Countersigned|$)"
BULLET = r"^\s*([a-zA-Z]|\d{1,2}|[ivx]{1,4})[.)]\s+(.+?)(?=^\s*(?:[a-zA-Z]|\d{1,2}|[ivx]{1,4})[.)]\s+|\Z)"
LEGAL_ANCHORS = [
    r"land\s+referred\s+to(?:\s+(?:herein|in\s+this\s+(?:Commitment|Policy)))?[^\n]{0,200}?(?:is\s+described|described\s+as\s+follows|to\s+wit)[\s:]*",
    r"(?:legal\s+description|description\s+of\s+(?:the\s+)?(?:land|property|premises))[\s:]+",
    r"real\s+property\s+described\s+below[\s:]+",
    r"Exhibit\s+[A-Z][\s.:\-]{0,5}(?:Legal\s+Description)?[\s:]*",
    r"(?=Beginning\s+at\s+a\s+point)",
    r"(?=Commencing\s+at\s+a\s+point)",
]
LEGAL_END = r"\b(?:schedule\s+b|requirements?|exceptions?|witness|in\s+witness\s+whereof|signed|signature|notary\s+public|countersigned|END\s+OF\s+SCHEDULE)\b"
LEGAL_WORDS = r"\b(lot|block|plat|subdivision|tract|metes|bounds|parcel|apn|section|township|range|beginning\s+at|commencing\s+at|thence|acres?|square\s+feet|condominium|easement)\b"
LOT = r"\bLot\s+(?:No\.?\s+)?([A-Za-z0-9-]+)"
BLOCK = r"\bBlock\s+(?:No\.?\s+)?([A-Za-z0-9-]+)"
SUBDIVISION = r"\b(?:Subdivision|Addition)\s+(?:of\s+)?([A-Z][A-Za-z0-9 .,&'-]{2,80})"
PARCEL = r"\b(?:APN|A\.?P\.?N\.?|Parcel(?:\s+ID|\s+Number|\s+#)?|PIN|Tax\s+(?:Parcel|Map\s+No))[:\s#]+([A-Za-z0-9.\-/]+)"
PAGE_HEADING = r"^##\s*Page\s+(\d+)"
STAMPED = r"\brecord(?:ed|ing)?\b"
NOTARIZED = r"\bnotary|notarial|acknowledged\b"
#: Types of documents that are links of the chain of title, and liens, themselves.
SELF_LINKS = ("warranty_deed", "grant_deed", "quitclaim_deed", "deed_of_trust", "mortgage", "release", "affidavit", "court_order")
SELF_LIENS = ("mortgage", "deed_of_trust")
STANDARD_PHRASES = "|".join(
    (
        "rights or claims of parties in possession",
        "encroachments, overlaps",
        "easements or claims of easements not shown",
        "any lien, or right to a lien, for services",
        "taxes or special assessments which are not shown",
        "discrepancies, conflicts in boundary lines",
        "general exceptions",
        "defects, liens, encumbrances, adverse claims",
    )
)
#: field, section title, query, structured fields
SECTIONS = [
    ("s1_vesting_and_estate", "Vesting and Estate", "Schedule A vested owner, estate or interest, proposed insured, effective date", "vesting,estate_or_interest,proposed_insured,effective_date"),
    ("s2_legal_description", "Legal Description", "legal description parcel lot block subdivision metes bounds APN", "legal_description"),
    ("s3_chain_of_title", "Chain of Title", "deeds chain of title grantor grantee recording book page instrument number", "chain_of_title,parties"),
    ("s4_open_encumbrances_and_liens", "Open Encumbrances and Liens", "open liens mortgages deeds of trust judgments unreleased encumbrances", "open_liens,released_liens"),
    ("s5_easements_and_restrictions", "Easements and Restrictions", "easements restrictions covenants rights of way utility access declarations", "easements,restrictions"),
    ("s6_requirements_schedule_b_i", "Requirements - Schedule B-I", "Schedule B part I requirements payoff releases execution recordation title company", "schedule_b_requirements"),
    ("s7_exceptions_schedule_b_ii", "Exceptions - Schedule B-II", "Schedule B part II exceptions standard exceptions taxes survey matters mineral rights", "schedule_b_exceptions"),
    ("s8_taxes_and_survey_matters", "Taxes and Survey Matters", "tax certificate assessed taxes delinquent taxes survey encroachments boundary matters", "taxes,survey_matters"),
]
#: Template sentences by section, with holes for the facts found, and what is said without any; the parts that fill a hole.
S1 = "Title appears vested in {owners}{estate}{insured}{effective}; capacity, marital status, and prior vesting must be confirmed against the recorded vesting deed."
S1_NO_OWNER = "the vested owner is not clearly extracted from the source"
S1_ESTATE = " in {estate}"
S1_INSURED = " with proposed insured {insured}"
S1_EFFECTIVE = " as of {effective}"
S2 = 'The legal description is {kind} and reads: "{text}"{parcel}; compare against the recorded plat or metes-and-bounds in the vesting deed.'
S2_PARCEL = ", parcel ID {parcel}"
S2_NONE = "No legal description was reliably extracted; obtain the full description from the recorded vesting deed or commitment Schedule A."
S3 = "The chain of title contains {n} recorded link(s): {links}. Confirm book/page on the recorded copies and reconcile against the recorder's index."
S3_LINK = "{kind} from {grantor} to {grantee}{reference}"
S3_NO_GRANTOR = "an unidentified grantor"
S3_NO_GRANTEE = "an unidentified grantee"
S3_NONE = "No prior chain links were extracted; obtain back-title from the county recorder for the subject parcel."
S4 = "Open encumbrances of record include {n} item(s): {liens}. Require payoff, release, or specific exception before policy issuance."
S4_LIEN = "{kind} in favor of {creditor}{amount}"
S4_AMOUNT = " for ${amount}"
S4_NONE = "No open liens or encumbrances were extracted from the source; run a current lien search before relying on this conveyance."
S5 = "The source extraction identifies {burdens}; verify each holder, recording reference, and discriminatory-redaction status before policy issuance."
S5_EASEMENTS = "{n} easement(s) of type {kinds}"
S5_RESTRICTIONS = "{n} restriction record(s) of type {kinds}"
S5_NONE = "No easements or restrictions were extracted; check the recorded plat and CC&Rs for utility easements, rights-of-way, and subdivision restrictions."
S6 = "Schedule B-I lists {n} closing requirement(s) covering {kinds}; each must be satisfied before the policy can issue."
S6_NONE = "No Schedule B-I requirements were extracted; obtain the commitment's Section I to enumerate the closing requirements (payoff, recordation, releases, signatures)."
S7 = "Schedule B-II lists {n} policy exception(s) ({standard} standard, {specific} specific). Specific exceptions should be cleared or expressly accepted by the proposed insured."
S7_NONE = "No Schedule B-II exceptions were extracted; obtain the commitment's Section II to enumerate the standard and specific exceptions to coverage."
S8 = "Taxes and survey review extracted {matters}; obtain a current tax certificate and an updated ALTA/NSPS survey before closing."
S8_TAXES = "{n} tax record(s)"
S8_SURVEYS = "{n} survey matter(s) ({kinds})"
S8_NONE = "No tax records or survey matters were extracted; obtain a current county tax certificate and a modern ALTA/NSPS survey for the subject property."
OVERALL = "The preliminary title review is classified as {risk} based on the extracted source documents."
GAP = "Structured extraction did not contain {field}."
UNCITED = "Structured extraction for {doc_id}"
