"""Typed mentions of a text: contacts, dates, schools, degrees, employers, skills and more.

Rules look at lines in order and keep a little state between them (an open education section, values already seen), so
they run over Arrow batches of texts, texts in, rows of mentions out. Which of them stay is decided afterwards with
window functions. Spans are bytes of the UTF-8 text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import values
from lodestar.functions.vectorised import small_batches

MOST_MENTIONS, VALUE_BYTES = 256, 4096
#: Texts whose mentions are held at once, and texts of a task where they are dealt out.
PIECE, TASK_ROWS = 200, 5000
SCHEMA = "entity_type string, raw_value string, normalized_value string, span_start int, span_end int, confidence double"
ARROW = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64())
#: The order in which types take turns when mentions have to be left out.
TYPES = ("name", "email", "phone", "wechat", "years_experience", "school", "school_tier", "degree", "major", "company", "title", "location", "skill", "certificate", "date_range")

# Labels, headers, marks and patterns of the rules.
SECTION_HEADERS = frozenset((
    "profile", "summary", "contact", "contacts", "education", "experience", "project", "projects", "skill", "skills", "technical skills",
    "technical stack", "tech stack", "certificate", "certificates", "certifications", "个人信息", "联系方式", "教育经历", "工作经历", "项目经历", "技能", "专业技能", "技术栈",
    "证书",
))
EDUCATION_HEADERS = frozenset((
    "education", "education background", "academic background", "academic history", "学历", "学位", "教育", "教育经历", "学习经历", "教育背景",
))
SKILL_HEADERS = frozenset((
    "skill", "skills", "technical skill", "technical skills", "technical stack", "tech stack", "技能", "专业技能", "技术栈",
))
CERTIFICATE_HEADERS = frozenset((
    "certificate", "certificates", "certification", "certifications", "证书", "认证", "资格",
))
SCHOOL_LABELS = frozenset((
    "school", "university", "college", "institution", "institute", "学校", "院校", "毕业院校", "大学",
))
TIER_LABELS = frozenset((
    "school tier", "school_tier", "university tier", "institution tier", "tier", "学校层次", "院校层次", "高校层次", "学校类型", "院校类型", "高校类型",
))
DEGREE_LABELS = frozenset((
    "degree", "education", "education level", "qualification", "学历", "学位", "教育", "最高学历",
))
MAJOR_LABELS = frozenset((
    "major", "field", "field of study", "study field", "specialization", "specialisation", "concentration", "专业", "所学专业", "主修", "主修专业", "专业方向",
    "研究方向",
))
COMPANY_LABELS = frozenset((
    "company", "employer", "organization", "organisation", "workplace", "公司", "单位", "雇主", "组织",
))
TITLE_LABELS = frozenset((
    "title", "role", "position", "job title", "职位", "岗位", "职务", "角色",
))
LOCATION_LABELS = frozenset((
    "location", "current location", "base", "city", "base city", "preferred city", "work location", "所在地", "地点", "城市", "现居地", "居住地", "工作地点", "期望城市",
))
ADDRESS_LABELS = frozenset((
    "address", "current address", "mailing address", "residential address", "home address", "地址", "现居住地址", "居住地址", "通讯地址",
))
CONTACT_STARTS = ("email", "phone", "mobile", "tel", "wechat", "weixin", "wx", "邮箱", "电话", "手机", "微信")
SCHOOL_MARKS = ("university", "college", "institute", "大学", "学院")
COMPANY_ENDS = (" co., ltd.", " co., ltd", " co. ltd.", " co. ltd", " co ltd", " pte. ltd.", " pte. ltd", " pte ltd", " private limited", " limited", " gmbh", " s.a.", " s.a", " sa", " inc.", " inc", " llc", " ltd.", " ltd", " corp", " corporation", " company", " technologies", " labs", " group", " bank")
COMPANY_MARKS = ("有限责任公司", "股份有限公司", "有限合伙", "合伙企业", "有限公司", "公司", "集团")
# Where a company's name is cut.
COMPANY_CUT = (" co., ltd", " co. ltd", " co ltd", " company limited", " pte. ltd", " pte ltd", " private limited", " incorporated", " corporation", " technologies", " limited", " company", " group", " labs", " gmbh", " s.a", " sa", " inc", " llc", " ltd", " corp", " co.", " co", " bank", *COMPANY_MARKS)
ADDRESS_PLACES = (
    "San Francisco", "New York City", "New York", "Hong Kong", "Los Angeles", "San Jose", "Singapore", "Chongqing", "Shanghai", "Hangzhou",
    "Shenzhen", "Beijing", "Guangzhou", "Suzhou", "Nanjing", "Chengdu", "Wuhan", "Tianjin", "Changsha", "Qingdao", "Toronto", "Vancouver", "Seattle",
    "Austin", "Boston", "北京市", "北京", "上海市", "上海", "深圳市", "深圳", "广州市", "广州", "杭州市", "杭州", "南京市", "南京", "苏州市", "苏州", "成都市", "成都", "武汉市", "武汉", "香港",
    "重庆市", "重庆", "天津市", "天津", "长沙市", "长沙", "青岛市", "青岛", "合肥市", "合肥", "西安市", "西安",
)
TIER_PATTERNS = (
    ("985", 0.92, r"\bc9\s+league\b|\bproject\s*985\b|\b985\s*project\b|985\s*工程|985"),
    ("211", 0.90, r"\bproject\s*211\b|\b211\s*project\b|211\s*工程|211"),
    ("double_first_class", 0.90, r"double[-\s_]*first[-\s_]*class|双一流(?:建设高校|建设大学|高校|院校|大学)?"),
    ("overseas", 0.86, r"overseas|foreign\s+university|international\s+university|ivy\s+league|russell\s+group|海外高校|海外院校|海外学校|海外|国外"),
    ("regular", 0.82, r"regular\s+university|ordinary\s+university|普通高校|普通院校|普通本科|普通大学"),
)
DEGREE_PATTERNS = (
    ("doctor", 0.96, r"\b(?:ph\.?\s*d\.?|phd|doctor(?:ate)?(?:\s+of\s+[A-Za-z ]+)?)\b|博士研究生|博士"),
    ("master", 0.95, r"\b(?:master(?:'s)?(?:\s+of\s+[A-Za-z ]+)?|m\.?\s*sc|m\.?\s*s\.?|m\.?\s*a\.?|m\.?\s*eng|m\.?\s*tech|m\.?\s*phil|mba)\b|硕士研究生|硕士|研究生"),
    ("bachelor", 0.95, r"(?:\bb\.\s*e\.|\b(?:bachelor(?:'s)?(?:\s+of\s+[A-Za-z ]+)?|b\.?\s*sc|b\.?\s*s\.?|b\.?\s*a\.?|b\.?\s*tech|b\.?\s*eng|beng)\b)|本科|学士"),
    ("associate", 0.90, r"\bassociate(?:\s+degree)?\b|大专|专科"),
    ("high_school", 0.90, r"\bhigh\s+school\b|高中"),
)
MAJOR_PATTERNS = (
    ("computer_science", 0.94, r"\bcomputer\s+science\b|计算机科学(?:与技术)?"),
    ("software_engineering", 0.94, r"\bsoftware\s+engineering\b|软件工程"),
    ("data_science", 0.94, r"\bdata\s+science\b|数据科学"),
    ("information_systems", 0.90, r"\binformation\s+systems?\b|信息系统"),
    ("electronic_engineering", 0.90, r"\belectronic(?:s)?\s+engineering\b|电子(?:信息)?工程"),
    ("mathematics", 0.90, r"\bmathematics?\b|数学"),
    ("statistics", 0.90, r"\bstatistics?\b|统计学?"),
    ("finance", 0.88, r"\bfinance\b|金融学?"),
    ("economics", 0.88, r"\beconomics?\b|经济学?"),
    ("business_administration", 0.88, r"\bbusiness\s+administration\b|工商管理"),
    ("artificial_intelligence", 0.92, r"\bartificial\s+intelligence\b|人工智能"),
    ("computer_engineering", 0.91, r"\bcomputer\s+engineering\b|计算机工程"),
    ("cybersecurity", 0.90, r"\bcyber\s*security\b|网络安全|信息安全"),
    ("network_engineering", 0.90, r"\bnetwork\s+engineering\b|网络工程"),
    ("communication_engineering", 0.90, r"\bcommunications?\s+engineering\b|通信工程"),
    ("mechanical_engineering", 0.90, r"\bmechanical\s+engineering\b|机械工程"),
    ("automation", 0.88, r"\bautomation\b|自动化"),
    ("accounting", 0.88, r"\baccount(?:ing|ancy)\b|会计学?"),
    ("marketing", 0.88, r"\bmarketing\b|市场营销"),
    ("human_resources", 0.88, r"\bhuman\s+resources?(?:\s+management)?\b|人力资源管理"),
)
SKILL_PATTERNS = (
    ("AWS", r"\b(?:aws|amazon\s+web\s+services)\b"), ("Azure", r"\b(?:azure|microsoft\s+azure)\b"), ("GCP", r"\b(?:gcp|google\s+cloud(?:\s+platform)?)\b"),
    ("Terraform", r"\bterraform\b"), ("Ansible", r"\bansible\b"), ("Jenkins", r"\bjenkins\b"), ("GitLab CI", r"\bgitlab\s+ci(?:/cd)?\b"),
    ("Kafka", r"\b(?:apache\s+)?kafka\b"), ("Flink", r"\b(?:apache\s+)?flink\b"), ("Elasticsearch", r"\belastic\s*search\b"), ("MongoDB", r"\bmongo\s*db\b"),
    ("Snowflake", r"\bsnowflake\b"), ("Spark", r"\b(?:apache\s+)?spark\b"), ("Hadoop", r"\b(?:apache\s+)?hadoop\b"), ("Airflow", r"\b(?:apache\s+)?airflow\b"),
    ("TensorFlow", r"\btensor\s*flow\b"), ("PyTorch", r"\bpy\s*torch\b"), ("scikit-learn", r"\b(?:scikit[-\s]?learn|sklearn)\b"), ("Vue.js", r"\bvue(?:\.js)?\b"),
    ("Angular", r"\bangular\b"), ("GraphQL", r"\bgraph\s*ql\b"), ("React", r"\breact(?:\.js)?\b"), ("Node.js", r"\bnode(?:\.js|js)?\b"), ("Spring Cloud", r"\bspring\s+cloud\b"),
    ("JavaScript", r"\b(?:java\s*script|javascript|js)\b"), ("TypeScript", r"\b(?:type\s*script|typescript|ts)\b"), ("PostgreSQL", r"\b(?:postgre\s*sql|postgresql|postgres)\b"),
    ("SQLite", r"\bsqlite\b"), ("Tantivy", r"\btantivy\b"), ("MySQL", r"\bmysql\b"), ("Kubernetes", r"\b(?:kubernetes|k8s)\b"), ("Docker", r"\bdocker\b"), ("Python", r"\bpython\b"),
    ("Rust", r"\brust\b"), ("Java", r"\bjava\b"), ("Go", r"\b(?:go|golang)\b"), ("Redis", r"\bredis\b"), ("SQL", r"\bsql\b"),
)
CERTIFICATE_PATTERNS = (
    ("aws_solutions_architect", 0.90, r"\baws\s+(?:certified\s+)?solutions?\s+architect(?:\s+associate|\s+professional)?\b|\bsaa-c0[23]\b"),
    ("aws_developer", 0.90, r"\baws\s+(?:certified\s+)?developer(?:\s+associate)?\b|\bdva-c0[12]\b"),
    ("aws_security_specialty", 0.90, r"\baws\s+(?:certified\s+)?security(?:\s*-\s*|\s+)specialty\b|\bscs-c0[12]\b"),
    ("azure_administrator", 0.88, r"\bazure\s+administrator\b|\baz-104\b"),
    ("gcp_professional_data_engineer", 0.90, r"\b(?:google\s+(?:cloud\s+)?|gcp\s+)?professional\s+data\s+engineer\b"),
    ("cka", 0.90, r"\b(?:cka|certified\s+kubernetes\s+administrator)\b"),
    ("ckad", 0.90, r"\b(?:ckad|certified\s+kubernetes\s+application\s+developer)\b"),
    ("cks", 0.90, r"\b(?:cks|certified\s+kubernetes\s+security\s+specialist)\b"),
    ("hashicorp_terraform_associate", 0.88, r"\b(?:hashicorp\s+certified\s+)?terraform\s+associate\b"),
    ("gcp_associate_cloud_engineer", 0.88, r"\b(?:(?:google\s+(?:cloud\s+)?)|gcp\s+)?associate\s+cloud\s+engineer\b"),
    ("azure_developer", 0.88, r"\b(?:azure\s+developer(?:\s+associate)?|az-204)\b"),
    ("rhcsa", 0.86, r"\b(?:rhcsa|red\s+hat\s+certified\s+system\s+administrator)\b"),
    ("cissp", 0.90, r"\bcissp\b"), ("pmp", 0.90, r"\bpmp\b"), ("cfa_level_1", 0.88, r"\bcfa\s+level\s+(?:i|1)\b"), ("cfa", 0.86, r"\bcfa\b"), ("cpa", 0.86, r"\bcpa\b|注册会计师"),
    ("ccna", 0.88, r"\b(?:ccna|cisco\s+certified\s+network\s+associate)\b"),
)
#: Title classes in order: confidence, phrases of which one must occur, and marks of which one must occur too.
ROLE_MARKS = ("engineer", "developer", "工程师", "开发")
# Classes of titles and what tells them.
TITLE_RULES = (
    ("platform_engineer", 0.83, ("platform engineer", "平台工程师"), ()),
    ("security_engineer", 0.83, ("security engineer", "信息安全工程师", "安全工程师"), ()),
    ("mobile_engineer", 0.82, ("mobile engineer", "ios engineer", "android engineer", "移动端工程师", "移动开发"), ()),
    ("business_analyst", 0.80, ("business analyst", "业务分析师"), ()),
    ("frontend_engineer", 0.83, ("frontend", "front-end", "前端"), ROLE_MARKS),
    ("fullstack_engineer", 0.83, ("fullstack", "full-stack", "full stack", "全栈"), ROLE_MARKS),
    ("machine_learning_engineer", 0.83, ("machine learning engineer", "ml engineer", "机器学习工程师", "算法工程师"), ()),
    ("data_scientist", 0.83, ("data scientist", "数据科学家"), ()),
    ("devops_engineer", 0.83, ("devops engineer", "site reliability engineer", "运维工程师"), ()),
    ("qa_engineer", 0.82, ("qa engineer", "quality assurance engineer", "test engineer", "测试工程师"), ()),
    ("engineering_manager", 0.82, ("engineering manager", "研发经理", "技术经理", "工程经理"), ()),
    ("solutions_architect", 0.82, ("solutions architect", "solution architect", "架构师"), ()),
    ("backend_engineer", 0.84, ("backend engineer", "java engineer", "后端"), ()),
    ("software_engineer", 0.82, ("software engineer", "software developer"), ()),
    ("data_engineer", 0.82, ("data engineer", "数据工程"), ()),
    ("product_manager", 0.80, ("product manager", "产品经理"), ()),
)
# Months by their first letters, and their names as a pattern.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_MONTHS = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
_YEAR, _MONTH, _NOW = r"(19\d{2}|20\d{2})", "(0?[1-9]|1[0-2])", "present|current|now|ongoing"
DATE_PATTERNS = (
    rf"\b{_YEAR}[./-]{_MONTH}\s*(?:-|–|—|至|到)\s*{_YEAR}[./-]{_MONTH}\b",
    rf"\b{_YEAR}[./-]{_MONTH}\s*(?:-|–|—|至|到|to)\s*(?:(?:{_NOW})\b|至今|现在|目前|当前)",
    rf"{_YEAR}\s*年\s*{_MONTH}\s*月?\s*(?:-|–|—|至|到)\s*{_YEAR}\s*年\s*{_MONTH}\s*月?",
    rf"{_YEAR}\s*年\s*{_MONTH}\s*月?\s*(?:-|–|—|至|到)?\s*(?:至今|今|现在|目前|当前|(?:{_NOW})\b)",
    rf"\b({_MONTHS})\s+{_YEAR}\s*(?:-|–|—|to)\s*({_MONTHS})\s+{_YEAR}\b",
    rf"\b({_MONTHS})\s+{_YEAR}\s*(?:-|–|—|to)\s*(?:{_NOW})\b",
)
PUNCTUATION = ",;|/\\，；、"

_i = lambda p: re.compile(p, re.IGNORECASE)
_NAME = _i(r"^(?:name|candidate|姓名|候选人)\s*[:：]\s*(.+)$")
_EMAIL = re.compile(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b")
_MOBILE = re.compile(r"(?:^|[^\d])((?:(?:\+|00)?86[\s.-]*)?(1[3-9]\d[\s.-]*\d{4}[\s.-]*\d{4}))(?:$|[^\d])")
_PHONE = re.compile(r"(?:\+\d{1,3}[\s.-]*)?(?:\(\d{3}\)|\d{3,4})[\s.-]+\d{3,4}[\s.-]+\d{4}")
_WECHAT = _i(r"^\s*(?:wechat|weixin|wx|微信|微信号)\s*[:：]\s*([A-Za-z][A-Za-z0-9_.-]{5,31})\s*$")
_ANY_YEAR = re.compile(_YEAR)
_DATES = [re.compile(p, re.IGNORECASE if k not in (0, 2) else 0) for k, p in enumerate(DATE_PATTERNS)]
_TIERS, _DEGREES, _MAJORS, _CERTIFICATES = ([(n, c, _i(p)) for n, c, p in table] for table in (TIER_PATTERNS, DEGREE_PATTERNS, MAJOR_PATTERNS, CERTIFICATE_PATTERNS))
_SKILLS = [(n, 0.91, _i(p)) for n, p in SKILL_PATTERNS]
_PLACES = values.aliases(values.LOCATIONS)
_COLON = re.compile("[:：]")
_any = lambda marks: re.compile("|".join(map(re.escape, marks)))
_SCHOOL_MARKS, _COMPANY_MARKS, _TITLE_MARKS = _any(SCHOOL_MARKS), _any(COMPANY_MARKS), _any([p for _, _, phrases, _ in TITLE_RULES for p in phrases])
_SKILL_MARKS, _CERTIFICATE_MARKS = _any(("skill", "technical stack", "tech stack", "技术栈", "技能")), _any(("certified", "certificate", "certification", "证书", "认证"))


class Line(NamedTuple):
    """A trimmed, non-blank line and where it begins in the text (characters)."""

    text: str
    at: int
    size: int  # bytes


class Mention(NamedTuple):
    type: str
    raw: str
    value: str
    start: int
    end: int
    confidence: float


def squeeze(text: str) -> str:
    return " ".join(text.split())


def text_of_lines(text: str) -> list[Line | None]:
    """Lines of the text; None for a blank one."""
    out, at = [], 0
    for raw in text.split("\n"):
        bare = raw.strip()
        out.append(Line(bare, at + len(raw) - len(raw.lstrip()), len(bare.encode())) if bare else None)
        at += len(raw) + 1
    return out


def labelled(line: Line, labels: frozenset[str]) -> Line | None:
    """The value of a ``label: value`` line, possibly empty; None if the label is another."""
    m = _COLON.search(line.text)
    if not m or line.text[: m.start()].strip().lower() not in labels:
        return None
    rest = line.text[m.end() :]
    bare = rest.strip()
    return Line(bare, line.at + m.end() + len(rest) - len(rest.lstrip()), len(bare.encode()))


def is_contact(text: str) -> bool:
    low = text.lower()
    return "@" in low or low.startswith(CONTACT_STARTS)


def is_school(text: str) -> bool:
    return _SCHOOL_MARKS.search(text.lower()) is not None


def is_company(text: str) -> bool:
    low = text.lower()
    return low.endswith(COMPANY_ENDS) or _COMPANY_MARKS.search(low) is not None


def is_skill_line(text: str) -> bool:
    return _SKILL_MARKS.search(text.lower()) is not None


def is_certificate_line(text: str) -> bool:
    low = text.lower()
    return low not in CERTIFICATE_HEADERS and _CERTIFICATE_MARKS.search(low) is not None


def title_class(text: str) -> tuple[str, float] | None:
    """The class of a title line. Few lines have a phrase of a class, so what excludes a line is looked at last."""
    low = text.lower()
    if not _TITLE_MARKS.search(low):
        return None
    found = next(((name, c) for name, c, phrases, marks in TITLE_RULES if any(p in low for p in phrases) and (not marks or any(m in low for m in marks))), None)
    return None if found is None or is_certificate_line(text) or is_skill_line(text) or any(p.search(text) for _, _, p in _CERTIFICATES) else found


def name_value(text: str) -> str | None:
    bare = text.strip().strip(",;|/\\，；").strip()
    if not bare or len(bare.encode()) > 80 or re.search("[@0-9]", bare) or bare.lower() in SECTION_HEADERS or is_contact(bare) or is_school(bare) or is_company(bare) or title_class(bare):
        return None
    english = 2 <= len(bare.split()) <= 4 and all(re.fullmatch(r"[A-Z][A-Za-z'.-]*", t) for t in bare.split())
    return squeeze(bare).lower() if english or re.fullmatch("[一-鿿]{2,6}", bare) else None


def place_value(text: str) -> str | None:
    bare = text.strip().strip(PUNCTUATION).strip()
    if not bare or len(bare.encode()) > 80 or "@" in bare:
        return None
    primary = re.split(f"[{re.escape(PUNCTUATION)}]", bare)[0].strip()
    if not primary or primary.lower() in SECTION_HEADERS or is_company(primary):
        return None
    low = squeeze(primary).lower()
    plain = re.fullmatch(r"[A-Za-z\s\-一-鿿]*", low) and len(low.encode()) <= 48
    return _PLACES.get(re.sub(r"[ \-_]", "", low)) or (low if plain else None)


def find_names(text: str, lines: list[Line | None]) -> Iterator[Mention]:
    for line in filter(None, lines[:12]):
        m = _NAME.match(line.text)
        if m and (value := name_value(m[1])):
            yield Mention("name", m[1].strip(), value, line.at + m.start(1), line.at + m.start(1) + len(m[1].strip()), 0.93)
            return
    for line in filter(None, lines[:5]):
        if value := name_value(line.text):
            yield Mention("name", line.text, value, line.at, line.at + len(line.text), 0.84)
            return
        if not is_contact(line.text):
            return


def find_contacts(text: str, lines: list[Line | None]) -> Iterator[Mention]:
    for m in _EMAIL.finditer(text) if "@" in text else ():
        yield Mention("email", m[0], m[0].lower(), m.start(), m.end(), 0.99)
    taken: list[tuple[int, int]] = []
    free = lambda a, b: all(b <= x or y <= a for x, y in taken)
    for m in _MOBILE.finditer(text):
        if free(*m.span(1)):
            taken.append(m.span(1))
            yield Mention("phone", m[1], "+86" + re.sub(r"\D", "", m[2]), *m.span(1), 0.98)
    for m in _PHONE.finditer(text):
        digits = re.sub(r"\D", "", m[0])
        plus = m[0].startswith("+")
        value = (f"+{digits}" if 11 <= len(digits) <= 15 else None) if plus else f"+1{digits}" if len(digits) == 10 else f"+{digits}" if len(digits) == 11 and digits[0] == "1" else None
        if value and free(*m.span()):
            taken.append(m.span())
            yield Mention("phone", m[0], value, *m.span(), 0.98)
    for line in filter(None, lines):
        if m := _WECHAT.match(line.text):
            yield Mention("wechat", m[1], m[1].lower(), line.at + m.start(1), line.at + m.end(1), 0.97)


def find_dates(text: str, lines: list[Line | None]) -> Iterator[Mention]:
    found = []
    for k, pattern in enumerate(_DATES if _ANY_YEAR.search(text) else ()):
        for m in pattern.finditer(text):
            parts = list(m.groups())
            if k >= 4:  # names of months come before their years
                parts = [x for a, b in zip(parts[::2], parts[1::2], strict=True) for x in (b, str(MONTHS.index(a[:3].lower()) + 1))]
            months = [f"{y}-{int(n):02d}" for y, n in zip(parts[::2], parts[1::2], strict=True)]
            found.append(Mention("date_range", m[0], f"{months[0]}/{months[1] if len(months) > 1 else 'PRESENT'}", m.start(), m.end(), 0.92))
    yield from found
    spans = []
    for d in found:
        start, _, end = d.value.partition("/")
        if end != "PRESENT":
            a, b = (int(x[:4]) * 12 + int(x[5:]) for x in (start, end))
            if b >= a:
                spans.append((a, max(b, a + 1)))
    total, reach = 0, -1
    for a, b in sorted(spans):
        total += max(0, b - max(a, reach))
        reach = max(reach, b)
    if total:
        first = min(found, key=lambda d: d.start)
        yield Mention("years_experience", first.raw, f"{total / 12:.1f}", first.start, first.end, 0.82)


def in_context(lines: list[Line | None], headers: frozenset[str], reach: int, most: int | None) -> Iterator[tuple[Line, bool]]:
    """Lines that are no headers, with whether they lie within ``reach`` lines after one of ``headers``."""
    left = 0
    for line in lines:
        if line is not None and line.text.lower() in headers:
            left = reach
        elif line is not None and left and line.text.lower() in SECTION_HEADERS:
            left = 0
        else:
            if line is not None and (most is None or line.size <= most):
                yield line, left > 0
            left = max(0, left - 1)


def first_alias(line: Line, table: list) -> tuple[str, float, int, int] | None:
    return next(((n, c, *m.span()) for n, c, p in table if (m := p.search(line.text))), None)


def all_aliases(kind: str, line: Line, table: list, seen: set[str], spare: bool = True, guard: Callable[[str, int, int], bool] = lambda *_: True) -> Iterator[Mention]:
    """Every alias of ``table`` in order, once per value; places that an earlier alias took are left out."""
    taken: list[tuple[int, int]] = []
    for name, confidence, pattern in table:
        for m in pattern.finditer(line.text):
            a, b = m.span()
            if name not in seen and guard(line.text, a, b) and not (spare and any(a < y and x < b for x, y in taken)):
                taken.append((a, b))
                seen.add(name)
                yield Mention(kind, m[0], name, line.at + a, line.at + b, confidence)


def school_part(line: Line) -> Line | None:
    part = labelled(line, SCHOOL_LABELS)
    part = line if part is None else part
    return part if part.text and is_school(part.text) else None


def find_education(text: str, lines: list[Line | None]) -> Iterator[Mention]:
    for line in filter(None, lines):
        if line.size <= 120 and (part := school_part(line)):
            yield Mention("school", part.text, squeeze(part.text).lower(), part.at, part.at + len(part.text), 0.84)
    seen: set[str] = set()
    apart = lambda t, a, b: not (t[a - 1 : a] in tuple("0123456789") or t[b : b + 1] in tuple("0123456789"))
    for line, inside in in_context(lines, EDUCATION_HEADERS, 8, 160):
        part = labelled(line, TIER_LABELS)
        part = part if part is not None else school_part(line) or (line if inside else None)
        if part and part.text:
            yield from all_aliases("school_tier", part, _TIERS, seen, False, apart)
    taken: list[tuple[int, int]] = []
    for line, inside in in_context(lines, EDUCATION_HEADERS, 8, 140):
        part = labelled(line, DEGREE_LABELS)
        part = part if part is not None and part.text else line if inside else None
        if part and (hit := first_alias(part, _DEGREES)):
            a, b = part.at + hit[2], part.at + hit[3]
            if all(b <= x or y <= a for x, y in taken):
                taken.append((a, b))
                yield Mention("degree", part.text[hit[2] : hit[3]], hit[0], a, b, hit[1])
    known: set[str] = set()
    for line, inside in in_context(lines, EDUCATION_HEADERS, 8, 140):
        value = labelled(line, MAJOR_LABELS)
        named = value is not None and bool(value.text)
        part = value if named else line if inside else None
        if part is None:
            continue
        hit = first_alias(part, _MAJORS)
        if hit is None and named:
            bare = part.text.strip(PUNCTUATION).strip()
            free = "_".join(re.findall(r"[^\W_]+", bare.lower()))
            if free and len(bare.encode()) <= 80 and not is_contact(bare) and bare.lower() not in SECTION_HEADERS:
                hit = (free, 0.86, 0, len(part.text))
        if hit and hit[0] not in known:
            known.add(hit[0])
            yield Mention("major", part.text[hit[2] : hit[3]], hit[0], part.at + hit[2], part.at + hit[3], hit[1])


def company_value(text: str) -> str:
    low = squeeze(text.strip().rstrip(".")).lower()
    suffix = next((s for s in COMPANY_CUT if low.endswith(s)), "")
    return low[: len(low) - len(suffix)].strip()


def find_work(text: str, lines: list[Line | None]) -> Iterator[Mention]:
    places: set[str] = set()
    for line in (x for x in lines if x and x.size <= 120):
        part = labelled(line, COMPANY_LABELS)
        part = part if part is not None else None if _COLON.search(line.text) else line
        if part and part.text and is_company(part.text) and (value := company_value(part.text)):
            yield Mention("company", part.text, value, part.at, part.at + len(part.text), 0.78)
        part = labelled(line, TITLE_LABELS)
        part = line if part is None else part
        if part.text and (found := title_class(part.text)):
            yield Mention("title", part.text, found[0], part.at, part.at + len(part.text), found[1])
        part = labelled(line, LOCATION_LABELS) or address_place(labelled(line, ADDRESS_LABELS))
        if part and part.text and (value := place_value(part.text)) and value not in places:
            places.add(value)
            yield Mention("location", part.text, value, part.at, part.at + len(part.text), 0.86)


def address_place(value: Line | None) -> Line | None:
    """The first component of an address that is a place, else the first known place inside it."""
    if value is None:
        return None
    for m in re.finditer(f"[^{re.escape(PUNCTUATION)}]+", value.text):
        bare = m[0].strip()
        if bare and place_value(bare):
            return Line(bare, value.at + m.start() + len(m[0]) - len(m[0].lstrip()), len(bare.encode()))
    low = value.text.lower()
    known = next((p for p in ADDRESS_PLACES if p.lower() in low), None)
    return Line(value.text[(k := low.index(known.lower())) : k + len(known)], value.at + k, len(known.encode())) if known else None


def find_skills(text: str, lines: list[Line | None]) -> Iterator[Mention]:
    seen: set[str] = set()
    for line, inside in in_context(lines, SKILL_HEADERS, 8, 180):
        value = labelled(line, SKILL_HEADERS)
        part = value if value is not None else line if inside or is_skill_line(line.text) else None
        if part and part.text:
            yield from all_aliases("skill", part, _SKILLS, seen)
    known: set[str] = set()
    for line, inside in in_context(lines, CERTIFICATE_HEADERS, 6, 140):
        value = labelled(line, CERTIFICATE_HEADERS)
        whole = value is not None or (not inside and is_certificate_line(line.text))
        part = value if value is not None else line if inside or whole else None
        if not part or not part.text:
            continue
        found = list(all_aliases("certificate", part, _CERTIFICATES, known))
        yield from found
        if not found and whole and (free := squeeze(part.text).lower()) not in known:
            known.add(free)
            yield Mention("certificate", part.text, free, part.at, part.at + len(part.text), 0.86)


RULES = (find_names, find_contacts, find_dates, find_education, find_work, find_skills)


def mentions_of(text: str | None, rules: tuple = RULES) -> list[Mention]:
    """All mentions of a text, spans in bytes; over-long values are left out."""
    if not text:
        return []
    lines = text_of_lines(text)
    found = [m for rule in rules for m in rule(text, lines) if max(len(m.raw.encode()), len(m.value.encode())) <= VALUE_BYTES]
    if text.isascii():
        return found
    cuts = sorted({x for m in found for x in (m.start, m.end)})
    at, done, bytes_ = {}, 0, 0
    for c in cuts:
        bytes_ += len(text[done:c].encode())
        done, at[c] = c, bytes_
    return [m._replace(start=at[m.start], end=at[m.end]) for m in found]


def all_mentions(texts: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple = RULES) -> DataFrame:
    """key and the mentions that ``rules`` find, a row each. Texts come in batches of a few MB and mentions go out by pieces of PIECE texts, so a task holds few."""
    small_batches(texts.sparkSession)
    source = texts.select(key, text)
    kinds = source.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE):
                piece = batch.slice(at, PIECE)
                found = [mentions_of(t.as_py(), rules) for t in piece.column(1)]
                whose = pa.array([i for i, ms in enumerate(found) for _ in ms], pa.int32())
                columns = zip(*(m for ms in found for m in ms), strict=True) if len(whose) else [()] * len(ARROW)
                yield pa.RecordBatch.from_arrays([piece.column(0).take(whose), *(pa.array(c, kind) for c, kind in zip(columns, ARROW, strict=True))], [key, *Mention._fields])

    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
    rows = source.mapInArrow(run, f"`{key}` {kinds}, " + SCHEMA)
    return rows.select(key, *names)


def spread(rows: DataFrame, each: int = TASK_ROWS) -> DataFrame:
    """Rows dealt over tasks of about ``each``: short rows that become long work lie in few file splits. ``rows`` is counted first."""
    return rows.repartition(max(1, -(-rows.count() // each)))


def retained(mentions: DataFrame, key: str = "doc_id", most: int = MOST_MENTIONS) -> DataFrame:
    """One row per type, value and span (the most confident), then at most ``most`` per key.

    Within a type the better ones come first; types take turns, so no type crowds out another. Adds ``place``, the
    order of what stays by span.
    """
    value = F.coalesce("normalized_value", "raw_value")
    better = [F.desc("confidence"), F.asc("span_start"), F.asc("span_end"), F.asc("raw_value"), F.asc(F.coalesce("normalized_value", F.lit("")))]
    same = Window.partitionBy(key, "entity_type", value, "span_start", "span_end").orderBy(*better)
    # One exchange by key serves all windows.
    distinct = mentions.repartition(key).withColumn("_n", F.row_number().over(same)).where("_n = 1").drop("_n")
    turn = F.row_number().over(Window.partitionBy(key, "entity_type").orderBy(*better))
    slot = F.array_position(F.array(*[F.lit(t) for t in TYPES]), F.col("entity_type"))
    limited = distinct.withColumn("_turn", turn).where(F.col("_turn") <= most).withColumn("_slot", slot)
    kept = limited.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_turn", "_slot"))).where(F.col("_n") <= most)
    place = F.row_number().over(Window.partitionBy(key).orderBy("span_start", "span_end", "_slot", "raw_value"))
    return kept.withColumn("place", place).drop("_turn", "_slot", "_n")


def extract(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return retained(all_mentions(texts, key, text), key)


def projected(mentions: DataFrame) -> DataFrame:
    """Rows as they are stored: a derived value has no span and an extractor of its own."""
    derived = F.col("entity_type") == "years_experience"
    return mentions.withColumns({
        "span_start": F.when(~derived, F.col("span_start")),
        "span_end": F.when(~derived, F.col("span_end")),
        "extractor": F.when(derived, "rules-v2-derived").otherwise("rules-v2"),
    })


def best_contact(mentions: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, email, phone: the most confident of each, then the first."""
    value = F.coalesce("normalized_value", "raw_value")
    order = F.struct(-F.col("confidence"), F.col("span_start"), value)
    best = lambda kind: F.min_by(F.when(F.col("entity_type") == kind, value), F.when(F.col("entity_type") == kind, order)).alias(kind)
    return mentions.where("entity_type IN ('email', 'phone')").groupBy(key).agg(best("email"), best("phone"))
