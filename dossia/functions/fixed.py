"""Fixed values that results depend on: word lists, patterns, thresholds and tables, stated as they are."""

#: PII categories in order: (type, severity, pattern, characters of context on each side).
PII_PATTERNS = [
    ("phone", "MEDIUM", r"\(0\d{1,2}\)\s*\d{3,4}-?\d{4}", 25),
    ("phone", "MEDIUM", r"09\d{2}-?\d{3}-?\d{3}", 25),
    ("residential_address", "HIGH", r"巷.{0,15}弄.{0,8}號", 40),
    ("id_number", "HIGH", r"[A-Z]\d{9}", 25),
]

#: Further categories that a caller may add.
PII_MORE = [
    ("email", "HIGH", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 25),
    ("ipv4", "LOW", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", 25),
]

#: Wrong term and its correction, in order.
TERMS = [
    ("計劃書", "計畫書"),
    ("計劃案", "計畫案"),
    ("協議合件", "協議合建"),
    ("更新單位", "更新單元"),
    ("都市更新條列", "都市更新條例"),
    ("公開展示", "公開展覽"),
    ("容積率獎勵", "容積獎勵"),
    ("申請報備", "申請報核"),
    ("審儀", "審議"),
    ("聽証", "聽證"),
    ("証明", "證明"),
    ("法定地價", "公告地價"),
    ("都市更新審議会", "都市更新審議會"),
    ("权利变换", "權利變換"),
    ("实施者", "實施者"),
]

#: Fields and patterns of numbers in running text.
NUMBER_PATTERNS = [
    ("accessible_parking", r"無障礙[停車位\s（(]*(\d+)\s*輛"),
    ("legal_parking", r"法定[汽車]*停車位[^\n]*\n?(\d+)\s*輛"),
    ("bonus_floor_area", r"合計獎勵樓地板面積[^\d]*(\d[\d,，.]+)"),
    ("ev_parking", r"充電(\d+)輛"),
]

#: Attachments and the words that show them.
ATTACHMENTS = {
    "實施者證明文件": ["實施者證明"],
    "更新單元核准函": ["更新單元核准函", "核准函"],
    "更新單元土地權屬清冊": ["土地權屬清冊"],
    "更新單元合法建築物權屬清冊": ["合法建築物權屬清冊"],
    "建築工程建材設備等級表": ["建材設備等級表", "建材設備"],
    "住戶管理規約": ["住戶管理規約", "管理規約"],
    "公辦公聽會相關資料": ["公辦公聽會", "自辦公聽會", "公聽會"],
    "聽證相關資料": ["聽證"],
    "都市更新事業計畫圖": ["事業計畫圖"],
    "不動產估價報告書摘要": ["不動產估價報告", "估價報告書"],
    "交通影響評估報告書摘要": ["交通影響評估"],
}

#: Regulation versions: label and first day in force, oldest first; the default is for missing dates.
VERSIONS = [("107年版", "2018-03-23"), ("108年版", "2019-01-30"), ("111年版", "2022-03-24"), ("113年版", "2024-12-03")]
DEFAULT_VERSION = "111年版"

SUBMISSION_TYPES = ["A-1", "B-1", "B-2", "C", "D"]
STATUS_RANK = {"fail": 0, "warn": 1, "skip": 2, "pass": 3}
SEVERITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3, "info": 4}
BONUS_SLACK, BONUS_SHARE, LIMIT_TOLERANCE = 0.1, 0.5, 2.0
NUMBER_TOLERANCE, PLAYBOOK_TOLERANCE = 0.1, 0.01
BONUS_CAP_PCT = 40.0
#: Consent thresholds (owners %, area %) by year, and the default.
CONSENT = {"113": (80.0, 80.0)}
CONSENT_DEFAULT = (200 / 3, 75.0)
AREA_TOLERANCE, VALUE_TOLERANCE = 0.5, 1.0
CONFIDENCE_BASE = {"field": 0.75, "cross": 0.75, "llm": 0.45}
CONFIDENCE_OTHER, EVIDENCE_BOOST, UNVERIFIED_LLM, CORROBORATED, REVIEW_BELOW = 0.50, 0.20, -0.10, 0.15, 0.60
MIN_QUOTE = 3

#: Years of the local calendar that a date may have.
ROC_YEARS = (100, 130)
#: Words near which a filing date stands, in order.
FILED_KEYWORDS = ["謄本", "報核", "送件", "申請日", "報核日"]
#: Stages other than filing.
OTHER_STAGES = ["公開展覽", "公聽會", "核定", "審議會", "幹事會"]

#: Front documents in order: the words that show them, and the words of which one must stand there too.
FRONT_DOCS = [
    ("申請書", ["都市更新事業計畫及權利變換計畫申請書", "都市更新事業計畫申請書", "都市更新申請書", "申  請  書"], ["申請人", "茲申請", "實施者", "統一編號", "申請日期", "報核", "此致", "代表人"]),
    ("切結書", ["切結書"], []),
    ("委託書", ["委  託  書", "委託書"], ["委託人", "受託", "茲委託", "委託事項"]),
    ("審議資料表", ["臺北市都市更新審議資料表", "都市更新審議資料表"], []),
]
TOC_MARKERS = ["目 錄", "目錄", "目 次", "目次", "頁次", "............", "………"]
#: Purposes of a power of attorney, in order.
POA_PURPOSES = [
    ("都更規劃", ["都更規劃", "都市更新規劃", "都更整合", "都市更新整合", "更新整合"]),
    ("建築設計", ["建築設計", "建築師", "建築規劃設計", "建築規劃"]),
    ("地政業務", ["地政業務", "地政士", "土地登記", "地政相關"]),
    ("估價業務", ["估價", "不動產估價師", "不動產估價"]),
    ("申請及審議事宜", ["審議事宜", "都市更新審議", "一切申請", "申請及出列席"]),
    ("代理辦理", ["代理辦理", "代為辦理", "全權代理", "代辦"]),
]
#: Documents whose date counts, in order, and the last page of the front section.
DATE_SOURCES = ["申請書", "切結書", "委託書"]
FRONT_PAGES, FRONT_SCAN = 20, 60

#: How the page of the review table is known: title, markers, and markers that survive bad recognition.
TABLE_TITLES = ["臺北市都市更新審議資料表", "都市更新審議資料表"]
TABLE_MARKERS = ["填表日期", "送審類別", "檔名", "實施方式"]
ROBUST_MARKERS = ["填表", "送審", "辦理過程", "基準容積", "獎勵樓地板", "法定容積", "停車位", "更新單元", "實施者", "容積獎勵", "報核"]
ROBUST_LEAST, TABLE_PAGES = 4, 30
#: Submission types in the order in which they are looked for, and the marks of a checked box.
CHECKED_TYPES = ["B-1", "A-1", "B-2", "C", "D"]
CHECK_MARKS = "■▪●✓√☑◆"

#: Fields of the review table: numbers, whole numbers, and those that decide whether extraction goes on.
FLOAT_FIELDS = ["land_area", "base_floor_area", "bonus_floor_area", "bonus_limit", "owner_consent_ratio"]
INT_FIELDS = ["legal_parking", "actual_parking", "accessible_parking", "ev_parking"]
TEXT_FIELDS = ["case_name", "implementer", "implementer_id", "submission_type", "fill_date"]
CRITICAL_FIELDS = ["bonus_floor_area", "bonus_limit", "legal_parking", "actual_parking", "land_area"]
VISION_BELOW = 0.6

#: Labels of fields in order: (words, field, words that veto); a tuple asks for all its words.
LABELS = [
    (["實設汽車停車位", "實設停車位", ("實設", "汽車停車位")], "actual_parking", []),
    (["法定汽車停車位", "法定停車位", ("法定", "汽車停車位", "含無障礙")], "legal_parking", []),
    (["無障礙"], "accessible_parking", ["含無障礙", "環境", "設計"]),
    (["充電車位", "充電"], "ev_parking", []),
    (["基地面積"], "land_area", []),
    (["基準容積"], "base_floor_area", ["+", "＋"]),
    (["獎勵樓地板面積合計", "合計獎勵樓地板面積", "獎勵面積合計", "獎勵合計", "容積獎勵申請額度", "申請額度"], "bonus_floor_area", []),
    (["容積獎勵上限", "獎勵上限"], "bonus_limit", []),
    (["土地所有權人同意比率", "所有權人同意"], "owner_consent_ratio", []),
    (["實施者"], "implementer", []),
    (["填表日期"], "fill_date", []),
]
#: Filled boxes on scans, and what stands for each submission type there.
FILLED_MARKS = "■▇█☑☒✓✔▪◼◾❚▓"
TYPE_WORDS = [
    ("A-1", ["A-1", "A－1", "送件版", "公開展覽"]),
    ("B-1", ["B-1", "B－1", "168專案小組", "專案小組版"]),
    ("B-2", ["B-2", "B－2", "幹事會複審", "幹事會"]),
    ("C", ["審議會版"]),
    ("D", ["核定版"]),
]
PARKING_MOST, DETECTION_LEAST, DETECTIONS_SHOWN = 5000, 0.5, 800
#: Prefixes that a model's submission type is cut to.
TYPE_PREFIXES = ["A-1", "B-1", "B-2"]

NUMBER_LABELS = {"accessible_parking": "無障礙停車位", "legal_parking": "法定(含無障礙)汽車停車位", "bonus_floor_area": "容積獎勵面積", "ev_parking": "充電車位"}
#: Pages that each scan reads.
TERM_PAGES, NUMBER_PAGES, ATTACHMENT_PAGES = (1, 40), (10, 60), (1, 20)

#: Names, severities and references of the rules.
RULES = {
    "DOC-001": ("申請書存在", "critical", "111年版注意事項第1條"),
    "DOC-002": ("切結書存在", "critical", "111年版注意事項第1條"),
    "DOC-003": ("委託書至少1份", "high", ""),
    "DOC-004": ("審議資料表存在", "critical", "111年版修訂第2點"),
    "FORM-001": ("送審類別已勾選", "high", ""),
    "FORM-002": ("審議資料表填表日期已填寫", "medium", ""),
    "CALC-001": ("容積獎勵申請額度不超過上限", "critical", "都更條例第65條；111年版修訂第6點"),
    "CALC-002": ("無障礙停車位數量符合法定最低要求", "critical", "建築技術規則第167條之六；111年版修訂第2點"),
    "FORM-003": ("充電車位欄位存在（111年版新增）", "high", "111年版修訂第2點"),
    "CALC-003": ("實設汽車停車位不低於法定要求", "critical", "建築技術規則第59條"),
    "CALC-004": ("容積獎勵上限計算驗算", "high", "都更條例第65條"),
    "PII-001": ("高風險個資遮蔽確認", "high", "個人資料保護法第5條"),
    "TERM-001": ("法定用詞錯誤", "medium", "臺北市都市更新自治條例"),
    "CONS-001": ("關鍵數字前後一致性", "high", ""),
}
#: Headings and advice of the opinion's sections.
OPINION = [("fail", "一、應修正項目（必檢）", "請實施者修正後再送。"), ("warn", "二、待人工核對項目（建議提醒）", "系統資料不足或需判讀，請承辦人工確認（非實施者違規）。")]

#: Section titles: marker at the front, and words that say whether a section is needed.
SECTION_MARKER = r"^(附錄[一二三四五六七八九十百]+|[壹貳參肆伍陸柒捌玖拾]+)、"
OPTIONAL_WORDS = ["若無則免附", "視實際情形", "請視實際"]
CHOOSE_WORDS = ["請擇一填寫", "擇一填寫", "請擇一"]
#: Kinds of documents by their file name, in order.
DOC_KINDS = ["事業概要計畫書附件冊", "事業概要計畫書", "事業計畫書附件冊", "事業計畫書", "權利變換計畫書附件冊", "權利變換計畫書"]

IMPACT_RANK = {"critical": 0, "major": 1, "medium": 2, "minor": 3}
TEST_MARKERS = ["test", "e2e", "測試"]
#: Case names of test runs in the history; `_` stands for any character.
TEST_RUNS = ["%e2e_test%", "%api_test%"]
#: Fields that two documents share, with unit and tolerance, and their rules.
SHARED = [
    ("land_area_sqm", "更新單元總面積", "CONS-AREA-001", "critical", "m²", 0.5, 2),
    ("owner_count", "土地所有權人人數", "CONS-OWN-001", "critical", "人", 0.0, 0),
    ("pre_renewal_value_wan", "更新前權利價值合計", "CONS-VAL-001", "warning", "萬元", 1.0, 1),
    ("post_renewal_value_wan", "更新後權利價值合計", "CONS-VAL-002", "warning", "萬元", 1.0, 1),
]
LLM_ERROR_TYPES, LLM_SEVERITIES = ["typo", "semantic_contradiction", "regulatory_violation"], ["critical", "warning"]
THUMBNAILS, LEAST_NATIVE, LEAST_TRIAGE = 12, 20, 30
