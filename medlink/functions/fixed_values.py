"""Words, patterns and constants that decide the results.

They are kept as plain text in one place because changing any of them changes
what the operators return.  Patterns are Java regular expressions, except that
word boundaries (\\b, \\m, \\M) are spelled out by ``functions.patterns`` where used.
"""

# --- fixed values: strength units, longest first -----------------------------
STRENGTH_UNITS = ("MMOL", "MEQ", "MCG", "MOL", "MG", "ML", "IU", "UG", "GM", "G", "U", "L", "%")

# --- fixed values: salt words ------------------------------------------------
SALT_WORDS = (
    "HCL", "HBR", "SODIUM", "POTASSIUM", "CALCIUM", "MAGNESIUM", "PHOSPHATE",
    "SULFATE", "NITRATE", "ACETATE", "CITRATE", "TARTRATE", "MONOHYDRATE",
    "DIHYDRATE", "HYDRATE", "ESTOLATE", "SUCCINATE", "MALEATE", "FUMARATE",
    "BESYLATE", "MESYLATE", "TOSYLATE", "GLUCONATE", "CHLORIDE",
)
SALT_NOTE_MAX_CHARS = 30

# --- fixed values: ingredient aliases (canonical -> other names) -------------
INGREDIENT_ALIASES = {
    "ETHYLPHENYLEPHRINE": ["ETILEFRIN", "ETILEFRINE"],
    "DIPYRONE": ["SULPYRIN", "SULPYRINE"],
    "BUTYLSCOPOLAMINE": ["HYOSCINE-N-BUTYLBROMIDE", "BUTYLSCOPOLAMINE BROMIDE"],
}

# --- fixed values: URL query keys that carry a permit number, in order -------
PERMIT_QUERY_KEYS = ("permitNo", "permitno", "permit_no", "licno", "licenseNo", "licId", "licid")
PERMIT_PATTERN = "(?:衛|署|部).{0,8}字第[0-9A-Z]+號"

# --- fixed values: flags -----------------------------------------------------
COMBO_MARK = "複"
COMBO_WORDS = ("Y", "YES", "TRUE", "COMBO")
NOT_CANCELLED = ("未註銷", "N", "0")

# --- fixed values: RFC 4122 URL namespace as hex -----------------------------
URL_NAMESPACE_HEX = "6ba7b8119dad11d180b400c04fd430c8"

# --- fixed values: dosage tails and OCR spacing ------------------------------
TOTAL_TAIL = r"(?is)[,，]?\s*總量\s*\d+\s*[一-鿿]{1,2}.*$"
DOSE_TAIL = r"(?is)\m\d+(\.\d+)?\s*(mcg|mg|g|ml|iu|%)\M.*$"
SPACED_DECIMAL = r"(\d)\s*\.\s*(\d)"
ORPHAN_NUMBER = r" \d+\.(\s|$)"
SPLIT_WORD = r"\m([a-z]{2,5}) +([a-z]{2,5})\M"
CLEAN_DOSE_TAIL = r"(?is)\s+\d+(\.\d+)?\s*(mcg|mg|g|ml|iu|%|tab|cap|bot|puff|puffs)\b.*$"

# --- fixed values: spelling repairs, then endings tried on cut-off words -----
SPELLING_REPAIRS = {
    "AMOXYCILLIN": "AMOXICILLIN",
    "CIMEDIN": "CIMETIDINE",
    "BENPROPERI": "BENPROPERINE",
}
CUT_OFF_ENDINGS = ("E", "NE", "INE", "IDE")

# --- fixed values: simplified -> traditional characters ----------------------
CJK_SIMPLIFIED_SHORT = "钰药维门间关体点东买卖电话书画车路针铁铜钢钱银锌钙钾钠铝"
CJK_TRADITIONAL_SHORT = "錠藥維門間關體點東買賣電話書畫車路針鐵銅鋼錢銀鋅鈣鉀鈉鋁"
CJK_SIMPLIFIED = "剂学胶软复灭适肠疗齿叶类视机选达过进还远连边这对导压变强针长门间关体点东买卖电话书画车路铁铜钢钱银锌钙钾钠铝乐锭药维页顺预题额风饮马验黄龙厂开产国医壶号汤发鉴麦龟"
CJK_TRADITIONAL = "劑學膠軟復滅適腸療齒葉類視機選達過進還遠連邊這對導壓變強針長門間關體點東買賣電話書畫車路鐵銅鋼錢銀鋅鈣鉀鈉鋁樂錠藥維頁順預題額風飲馬驗黃龍廠開產國醫壺號湯發鑑麥龜"

# --- fixed values: English OCR spacing ---------------------------------------
MERGE_EXCLUDED = ("mg", "ml", "mcg", "g", "iu", "kg", "cm", "mm")
MERGE_MAX_CHARS = 20
OCR_WORD_FIXES = (
    (r"(?i)Warnings\s*&\s*Precaut\s+ions", "Warnings & Precautions"),
    (r"(?i)Precaut\s+ions", "Precautions"),
    (r"(?i)Physiciam", "Physician"),
    (r"(?i)Pharmaci\s+st", "Pharmacist"),
)

# --- fixed values: line tests ------------------------------------------------
DOSAGE = r"(?i)\b\d+(?:\.\d+)?\s*(mg|mcg|g|ml|iu|%)\b"
PUFF = r"(?i)\b(?:puff|puffs)\b|\b\d+\s*puff\b"
FORM = r"(?i)\b(tab|tablet|cap|capsule|syrup|inj|inhal|spray|solution|susp|respimat)\b|滴眼|錠|膠囊|口服|吸入|噴霧|注射|溶液|懸浮"
PAREN_HINT = r"\(([A-Za-z][^)]+)\)"
PHONE_OR_CODE = r"(?:\b\d{2,3}\d{6,}\b|\b\d{2,4}-\d{3,4}-\d{3,4}\b|^\d{3,}$)"
BOILERPLATE = (
    r"(?i)\b(prescription|quantity|dispensing|pharmacist|physician|warnings|warning|side effects"
    r"|instruction|appearance|use before)\b"
    r"|領藥號|總量|用法|用途|外觀|警語|副作用|處方期限|調劑日期|藥師|醫師"
)
CONTAINER_WORD = r"(?i)\b(puff|puffs|bot|bottle)\b"
HEADER = (
    r"(?i)藥名|用法|用途|外觀|警語|副作用|領藥號|調劑日期|medication|instruction|indications"
    r"|appearance|warnings|side effects|prescription|dispensing"
)
META_LINE = (
    r"(?i)^(?:藥名|外用|內用|口服|飯前|飯後|睡前|藥品資訊連結|藥品查詢|資訊連結|medication|quantity"
    r"|use before|prescription|dispensing|appearance|instruction|indications|side effects|warnings|總量)\b"
)
META_PREFIX = (
    r"(?i)^(?:藥品資訊連結|藥品查詢|資訊連結|quantity|use before|prescription|dispensing|appearance"
    r"|instruction|indications|side effects|warnings)\b"
)
LABEL_WORDS = (
    r"quantity|appearance|instruction|indications|warnings?|side effects?|prescription|dispensing"
    r"|use before|藥名|總量|外觀|用法|用途|警語|副作用|領藥號|調劑日期|外用|內用|飯前|飯後|睡前"
    r"|藥品資訊連結|藥品查詢|資訊連結"
)
QUANTIFIER = "盒|瓶|錠|粒"
CJK_FORM = "噴|吸入|錠|膠囊|滴眼|注射|溶液|懸浮|粉|顆粒|口服"
QUANTITY_ONLY = r"^\d+\s*(盒|瓶|支|包|顆|粒|錠|会|合|金)$"
TOTAL_UNIT = r"(?i)[,，]?\s*總量\s*\d+\s*(盒|瓶|支|包|顆|粒|錠|金)"
TOTAL_ANY = r"[,，]?\s*總量\s*\d+\s*[一-鿿]{1,2}"
TOTAL_ENGLISH = r"(?i)[,，]?\s*quantity\s*\d+\s*(box|bottle|pack|packs|tabs?|caps?)"
NON_MEDICATION_TEXT = (
    "適應症[：:].*$", "警語[：:].*$", "成份名[：:].*$", r"\|\s*藥師\s*$", "代收健保.*$", r"[|｜]\s*$",
)
NON_MEDICATION_STARTS = (
    "適應症", "适应症", "警語", "警语", "成份名", "代收", "就醫", "就医", "日份", "合計", "合计",
    "調劑", "调剂", "藥師", "药师", "兹收到", "茲收到", "性別", "性别", "姓名", "病號", "病号",
    "身分證", "身份证", "就醫序", "就医序", "N處方", "N处方", "次量",
)
OTHER_LINE_MAX_CHARS = 60
OTHER_LINE_DOSE = r"(?i)\d+\s*(?:mg|mcg|g|ml|iu|cap|tab|inj|syr)"
TRAILING_DOSE = r"(?i)\s+\d+(\.\d+)?\s*(MG|GM|MCG|ML|IU|MEQ|MMOL|UNIT|UNITS|%)\s*$"

# --- fixed values: label words in a case text --------------------------------
SECTION_HEADER_START = (
    r"^(?:用法|用途|警語|副作用|外觀|藥名|總量|調劑日期|領藥號|調劑藥師|處方期限)"
    r"|(?i)^(?:instruction|indications|side effects|warnings|appearance|medication|quantity|use before"
    r"|dispensing date|prescription|pharmacist)"
)
SECTION_HEADERS = (
    "用法", "用途", "警語", "副作用", "外觀", "藥名", "總量", "調劑日期", "領藥號", "調劑藥師", "處方期限",
    "instruction", "indications", "side effects", "warnings", "appearance", "medication", "quantity",
    "use before", "dispensing date", "prescription", "pharmacist",
)
INSTRUCTION_HEADERS = (
    "instruction", "indications", "side effects", "warnings", "appearance", "medication", "quantity",
    "use before", "用法", "用途", "副作用", "警語", "外觀", "藥名", "總量", "處方期限", "領藥號", "調劑日期",
)
NAME_LABELS = (
    "處方醫師", "醫師", "physician", "調劑藥師", "藥師", "pharmacist", "期限", "use before", "dispensing",
    "日期", "date", "姓名", "用法", "用途", "警語", "副作用", "總量", "領藥號", "調劑日期", "instruction",
    "indications", "warnings", "side effects", "medication", "quantity", "appearance",
)

# --- fixed values: section anchors, in order ---------------------------------
SECTION_ANCHORS = (
    ("medication", ("藥名", "medication", "處方", "次量")),
    ("instruction", ("用法", "instruction")),
    ("indications", ("用途", "indications")),
    ("warnings", ("警語", "warnings")),
    ("side_effects", ("副作用", "side effects")),
    ("prescription_no", ("領藥號", "prescription no.")),
    ("dispensing_date", ("調劑日期", "dispensing date")),
    ("quantity", ("總量", "quantity")),
    ("pharmacist", ("調劑藥師", "pharmacist")),
)
SECTION_PADDING = 6
MEDICINE_SIGNAL = r"(?i)\b\d+(?:\.\d+)?\s*(mcg|mg|g|ml|iu|%)\b|\b(puff|puffs|bot|bottle)\b|\([^)]*[A-Za-z][^)]*\)"

# --- fixed values: page geometry, pixels or ratios ---------------------------
ROW_TOLERANCE_RATIO = 0.6
COLUMN_GAP_RATIO = 0.06
READING_ROW_TOLERANCE = 10
MERGE_ROW_TOLERANCE = 10
MERGE_GAP = 80
MERGE_GAP_ACROSS_BLOB = 300
BLOB_MIN_SIDE = 40
BLOB_ASPECT = (0.7, 1.4)
ELEMENT_MIN_CONFIDENCE = 0.75
GROUP_ALIGN_TOLERANCE = 80
GROUP_OVERLAP = 0.15
GROUP_FAR_OVERLAP = 0.1
GROUP_FAR_X = 120
COLUMN_SPLIT_X = 80

# --- fixed values: matching passes, in winner order with confidence ----------
MATCH_METHODS = (
    ("product_exact", 0.95),
    ("ocr_product", 0.90),
    ("canonical_exact", 0.95),
    ("alias_exact", 0.90),
    ("paren_alias_exact", 0.85),
    ("ingredient_token", 0.65),
    ("product_token_contain", 0.80),
    ("ocr_clean", 0.70),
    ("cjk_fuzzy", 0.85),
)
TOKEN_CONTAIN_RATIO = 0.60
CLEAN_MAX_INGREDIENTS = 50
CJK_MAX_PRODUCTS = 3

# --- fixed values: interaction severities ------------------------------------
SEVERITY_RANK = {"minor": 1, "moderate": 2, "major": 3}
DISCLAIMER = "This information supports, but does not replace, clinical judgment and patient-specific review."
SEVERITY_TEMPLATES = (
    (
        "major",
        "High-risk interaction",
        "These medicines can interact strongly. Talk to your doctor or pharmacist before using them together.",
        "Major interaction",
        "Avoid coadministration when possible. If combination therapy is necessary, use specialist review and close monitoring.",
        "Check for active ingredients, consider alternatives, and monitor closely if coadministration cannot be avoided.",
    ),
    (
        "moderate",
        "Use with caution",
        "These medicines may interact. Ask your doctor or pharmacist whether you need extra monitoring or dose changes.",
        "Moderate interaction",
        "Use caution with coadministration and consider monitoring, counseling, or dose adjustment based on the clinical context.",
        "Review benefits and risks, consider dose adjustment or monitoring, and counsel the patient about interaction symptoms.",
    ),
    (
        "minor",
        "Minor interaction",
        "These medicines have a lower-risk interaction, but you should still mention them to your care team.",
        "Minor interaction",
        "Interaction risk is lower, but document the combination and provide routine counseling as appropriate.",
        "Document the interaction, provide routine counseling, and monitor if clinically indicated.",
    ),
)
COVERAGE_NOTE = (
    "DDI screening coverage is limited to medicines in the Taiwan curated dictionary. "
    "If some medicines could not be checked, confirm with a clinician/pharmacist."
)
MESSAGE_NONE_FOUND = "No interactions found among the checked medicines."
MESSAGE_UNCHECKED = "Some medicines could not be checked for interactions. Confirm with a clinician/pharmacist."

# --- fixed values: hand-made interaction-name mappings -----------------------
MANUAL_NOTE = "manual map (base-name->salt/hydrate/form in TW concepts)"
MANUAL_NAME_MAP = (
    ("Promethazine", "58a8dc7a-bef0-56e1-a837-4dadca9a7f51"),
    ("Ethanol", "89497baa-8c8a-5280-a573-80fd1a3b6c09"),
    ("Ozanimod", "98b27219-c91a-577d-9864-786fee0ba263"),
    ("Doxepin", "30ce1b8d-9ee6-59a4-bb90-f194ffd4b8bb"),
    ("Warfarin", "85f17a1f-ce4f-56b1-8e93-da323b8e9767"),
    ("Nilotinib", "05234257-0d01-5591-ae69-f17f238089b7"),
    ("Mepyramine", "24b6c201-491c-5e15-b41a-318baed3b58f"),
    ("Alimemazine", "1853cb7f-a006-520e-a4d6-48440570b7d4"),
    ("Ribociclib", "195d42d8-e920-5498-b836-0272e8da9146"),
    ("Imatinib", "bcf7dce1-a744-5573-bef6-1dd54b3aa0ff"),
    ("Lapatinib", "06978039-4504-5f70-93e6-3fd992e4bf64"),
    ("Siponimod", "2d0392a0-f1c2-52a6-be7b-fc1e48c80373"),
    ("Hydroxychloroquine", "115573df-a33c-52d1-992f-59d84f20bd6f"),
    ("Ondansetron", "7a83199e-1cdc-5ece-b91d-a807d36e7225"),
    ("Doxepin (topical)", "30ce1b8d-9ee6-59a4-bb90-f194ffd4b8bb"),
    ("Pazopanib", "7afaeccd-7dc3-5e16-9824-b72fa3eebe5d"),
    ("Indacaterol", "f0cf8dba-deb4-5938-ad31-ae28c111a164"),
    ("Quinine", "b64c608a-a3fb-5d74-9768-a3024578af4f"),
    ("Glyburide", "1d47dcee-72bf-50fe-941c-60272ebdc607"),
    ("Fedratinib", "ea4f09e9-f59c-579f-97db-9c8bef371370"),
    ("Fludrocortisone", "33b6f96f-5103-55e4-a6c3-ff62f3c05690"),
    ("Cabozantinib", "cd4a206f-eae5-5735-8a51-0d88e54caf43"),
    ("Terbutaline", "08e78fe0-b225-5172-a25e-19ddc7cad8e8"),
    ("Epinephrine", "26f8b228-683f-5194-9d44-7a0994ccd25f"),
    ("Ponatinib", "cb282ba0-78eb-5459-a6a8-57a0fc0fe430"),
    ("Neomycin", "9ec35eef-f754-54f7-ba8b-e94819c06e77"),
    ("Ethinylestradiol", "9e3d20ef-6044-5c3f-a52a-9380dc73df5f"),
    ("Vilanterol", "cdc56654-cd6a-5ec0-a2d6-d50ed11b7e3e"),
    ("Procarbazine", "4e310b2b-7359-578f-bf3e-d2b05fb9f4b0"),
    ("Abiraterone", "d2e30042-d134-59c3-ad05-92b5c1c507bb"),
    ("Canagliflozin", "415d446a-5fd2-5ea6-a0e3-4e99e36c6b17"),
    ("Ertugliflozin", "0bd56c81-e3de-5c2d-9907-1b48e732926e"),
    ("Sorafenib", "ee6cfde1-6f1d-57b8-a65d-f72ca3ec08be"),
    ("Dabrafenib", "74c6c301-0f7f-5751-879c-b247e9acbaf5"),
    ("Pasireotide", "fafa18d7-ec0a-5c9b-9514-1cab51e8caf7"),
)

# --- fixed values: source headers (target column -> header, kind) ------------
ITEM_COLUMNS = (
    ("change_flag", "異動", "text"),
    ("product_code", "藥品代號", "text"),
    ("name_en", "藥品英文名稱", "text"),
    ("name_zh", "藥品中文名稱", "text"),
    ("ingredient_text", "成分", "text"),
    ("strength_value", "規格量", "decimal"),
    ("strength_unit", "規格單位", "text"),
    ("combo_flag", "單複方", "text"),
    ("price", "支付價", "decimal"),
    ("effective_start", "有效起日", "date"),
    ("effective_end", "有效迄日", "date"),
    ("vendor_name", "藥商", "text"),
    ("manufacturer_name", "製造廠名稱", "text"),
    ("dose_form", "劑型", "text"),
    ("drug_category", "藥品分類", "text"),
    ("category_group_name", "分類分組名稱", "text"),
    ("atc_code", "ATC代碼", "text"),
    ("reimbursement_section", "給付規定章節", "text"),
    ("permit_link", "藥品代碼超連結", "text"),
    ("reimbursement_section_link", "給付規定章節連結", "text"),
)
COMPONENT_COLUMNS = (
    ("component_code", "成分代碼", "text"),
    ("reimbursed_component_code", "核價成分代碼", "text"),
    ("reimbursed_component_name", "核價成分名稱", "text"),
)
PERMIT_COLUMNS = (
    ("permit_no", "許可證字號", "text"),
    ("cancel_status", "註銷狀態", "text"),
    ("cancel_date", "註銷日期", "date"),
    ("cancel_reason", "註銷理由", "text"),
    ("expiry_date", "有效日期", "date"),
    ("issue_date", "發證日期", "date"),
    ("permit_type", "許可證種類", "text"),
    ("old_permit_no", "舊證字號", "text"),
    ("customs_doc_no", "通關簽審文件編號", "text"),
    ("product_name_zh", "中文品名", "text"),
    ("product_name_en", "英文品名", "text"),
    ("indications", "適應症", "text"),
    ("dosage_form", "劑型", "text"),
    ("packaging", "包裝", "text"),
    ("drug_class", "藥品類別", "text"),
    ("controlled_substance_level", "管制藥品分類級別", "text"),
    ("ingredient_text", "主成分略述", "text"),
    ("applicant_name", "申請商名稱", "text"),
    ("applicant_address", "申請商地址", "text"),
    ("applicant_tax_id", "申請商統一編號", "text"),
    ("manufacturer_name", "製造商名稱", "text"),
    ("manufacturer_site_address", "製造廠廠址", "text"),
    ("manufacturer_company_address", "製造廠公司地址", "text"),
    ("manufacturer_country", "製造廠國別", "text"),
    ("manufacturing_process", "製程", "text"),
    ("change_date", "異動日期", "date"),
    ("usage_dosage", "用法用量", "text"),
    ("packaging_barcode", "包裝與國際條碼", "text"),
)
ATC_COLUMNS = (
    ("snapshot_date", "snapshot_date", "date"),
    ("record_type", "record_type", "text"),
    ("atc_code", "atc_code", "text"),
    ("atc_name", "atc_name", "text"),
    ("ddd", "ddd", "decimal"),
    ("uom", "uom", "text"),
    ("adm_r", "adm_r", "text"),
    ("note", "note", "text"),
    ("brand_name", "brand_name", "text"),
    ("dosage_form", "dosage_form", "text"),
    ("ingredients", "ingredients", "text"),
    ("ddd_comb", "ddd_comb", "text"),
)

# --- fixed values: character slices of the fixed-width file (start, end) -----
HISTORY_SLICES = (
    ("validation_status", 14, 15),
    ("product_code", 17, 27),
    ("price", 32, 37),
    ("effective_start", 38, 45),
    ("effective_end", 46, 53),
    ("name_en", 54, 178),
    ("package_quantity", 178, 182),
    ("package_unit", 183, 236),
    ("ingredient_text", 236, 298),
    ("strength_text", 298, 358),
    ("dose_form", 358, 601),
    ("manufacturer_short_name", 601, 754),
    ("name_zh", 758, 873),
    ("search_text", 873, 1776),
    ("manufacturer_name", 1776, 1808),
    ("atc_code", 1808, None),
)
HISTORY_BLOCK = r"(\d+(?:\.\d+)?)\s+([A-Z][A-Z ()/%\.-]*?)\s{2,}(\s*[^\d\s].*?)\s*$"
HISTORY_STRENGTH = r"^(.*?\S)\s{2,}(\S+)"
HISTORY_ATC = r"([A-Z][0-9A-Z]{2,7})\s*$"

# Words of lines that are about the product or the form, not a medicine.
META_NOISE_WORDS = (
    "藥品資訊連結", "藥品查詢", "資訊連結", "quantity", "use before", "prescription", "dispensing",
    "pharmacist", "physician", "indications", "side effects", "warnings", "appearance", "instruction",
)
