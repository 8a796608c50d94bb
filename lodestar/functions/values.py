"""Canonical values of degrees, schools, skills, majors, companies, titles, places and certificates.

Each is a lookup in a constant map, which Spark keeps as one literal; what is not in it keeps its folded form.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions.text import ascii_lower, fold_space, folded

# Aliases and the canonical value they stand for.
DEGREES = {
    "high_school": "highschool 高中 高中学历",
    "associate": "associate associatedegree college 大专 大专学历 专科 专科学历",
    "bachelor": "bachelor undergraduate bs ba btech beng 本科 大学本科 本科生 学士 学士学位",
    "master": "master ms ma mba msc meng mtech mphil 硕士 硕士研究生 硕士学位 研究生",
    "doctor": "doctor doctorate phd 博士 博士研究生 博士学位 博士生",
}
DEGREE_ORDER = tuple(DEGREES)
SCHOOL_TIERS = {
    "985": "985 project985 985project 985工程 c9league",
    "211": "211 project211 211project 211工程",
    "double_first_class": "doublefirstclass doublefirstclassuniversity 双一流 双一流建设高校 双一流建设大学 双一流高校 双一流院校",
    "overseas": "overseas oversea foreign foreignuniversity international internationaluniversity ivyleague russellgroup 海外 国外 海外高校 海外院校",
    "regular": "regular regularuniversity ordinary ordinaryuniversity ordinarycollege normal 普通 普通高校 普通院校 普通本科",
    "unknown": "unknown",
}
SKILLS = {
    "kubernetes": "k8s kubernetes",
    "go": "golang go",
    "postgresql": "postgres postgresql",
    "node.js": "nodejs node",
    "react": "reactjs react",
    "vue.js": "vuejs vue",
    "typescript": "ts typescript",
    "javascript": "js javascript",
    "scikit-learn": "sklearn scikitlearn",
    "pytorch": "pytorch",
    "tensorflow": "tensorflow",
    "graphql": "graphql",
    "aws": "amazonwebservices aws",
    "azure": "microsoftazure azure",
    "gcp": "googlecloudplatform googlecloud gcp",
    "terraform": "terraform",
    "ansible": "ansible",
    "jenkins": "jenkins",
    "gitlab ci": "gitlabci gitlabcicd",
    "kafka": "apachekafka kafka",
    "flink": "apacheflink flink",
    "elasticsearch": "elasticsearch elastic",
    "mongodb": "mongodb",
    "snowflake": "snowflake",
}
MAJORS = {
    "computer_science": "computerscience 计算机科学 计算机科学与技术",
    "software_engineering": "softwareengineering 软件工程",
    "data_science": "datascience 数据科学",
    "information_systems": "informationsystem informationsystems 信息系统",
    "electronic_engineering": "electronicengineering electronicsengineering 电子工程 电子信息工程",
    "mathematics": "mathematics math 数学",
    "statistics": "statistics statistic 统计 统计学",
    "finance": "finance 金融 金融学",
    "economics": "economics economic 经济 经济学",
    "business_administration": "businessadministration 工商管理",
    "artificial_intelligence": "artificialintelligence 人工智能",
    "computer_engineering": "computerengineering 计算机工程",
    "cybersecurity": "cybersecurity 网络安全 信息安全",
    "network_engineering": "networkengineering 网络工程",
    "communication_engineering": "communicationengineering communicationsengineering 通信工程",
    "mechanical_engineering": "mechanicalengineering 机械工程",
    "automation": "automation 自动化",
    "accounting": "accounting accountancy 会计 会计学",
    "marketing": "marketing 市场营销",
    "human_resources": "humanresources humanresourcemanagement 人力资源管理",
}
TITLES = {
    "backend_engineer": "senior_backend_engineer staff_backend_engineer backend_developer backend_engineer 后端工程师 高级后端工程师",
    "product_manager": "product_manager 产品经理",
    "frontend_engineer": "frontend_engineer front_end_engineer staff_frontend_engineer 前端工程师",
    "data_scientist": "data_scientist 数据科学家",
    "devops_engineer": "devops_engineer dev_ops_engineer",
    "engineering_manager": "engineering_manager 工程经理",
}
LOCATIONS = {
    "shanghai": "shanghai 上海 上海市",
    "hangzhou": "hangzhou 杭州 杭州市",
    "shenzhen": "shenzhen 深圳 深圳市",
    "beijing": "beijing 北京 北京市",
    "guangzhou": "guangzhou 广州 广州市",
    "suzhou": "suzhou 苏州 苏州市",
    "nanjing": "nanjing 南京 南京市",
    "chengdu": "chengdu 成都 成都市",
    "wuhan": "wuhan 武汉 武汉市",
    "chongqing": "chongqing 重庆 重庆市",
    "tianjin": "tianjin 天津 天津市",
    "xian": "xian 西安 西安市",
    "changsha": "changsha 长沙 长沙市",
    "hefei": "hefei 合肥 合肥市",
    "qingdao": "qingdao 青岛 青岛市",
    "hong_kong": "hongkong hongkongsar 香港 香港特别行政区",
    "taipei": "taipei 台北 台北市",
    "singapore": "singapore 新加坡",
    "san_francisco": "sanfrancisco sanfranciscobayarea sfbayarea bayarea",
    "san_jose": "sanjose",
    "new_york": "newyork newyorkcity nyc 纽约 纽约市",
    "los_angeles": "losangeles la",
    "seattle": "seattle",
    "boston": "boston",
    "austin": "austin",
    "toronto": "toronto",
    "vancouver": "vancouver",
    "tokyo": "tokyo 东京",
    "london": "london 伦敦",
    "berlin": "berlin",
    "paris": "paris 巴黎",
    "remote": "remote 远程",
}
CERTIFICATES = {
    "aws_solutions_architect": "aws_certified_solutions_architect aws_solutions_architect_associate aws_solutions_architect_professional saa_c02 saa_c03",
    "aws_developer": "aws_certified_developer aws_developer_associate dva_c01 dva_c02",
    "azure_administrator": "az_104",
    "azure_developer": "azure_developer azure_developer_associate az_204",
    "cka": "certified_kubernetes_administrator",
    "ckad": "certified_kubernetes_application_developer",
    "cks": "certified_kubernetes_security_specialist",
    "hashicorp_terraform_associate": "hashicorp_certified_terraform_associate terraform_associate",
    "gcp_associate_cloud_engineer": "google_associate_cloud_engineer google_cloud_associate_cloud_engineer gcp_associate_cloud_engineer",
    "cfa_level_1": "cfa_level_i cfa_level_1",
    "rhcsa": "red_hat_certified_system_administrator",
    "cpa": "注册会计师",
}
COMPANY_SUFFIXES_EN = (
    " co., ltd.", " co., ltd", " co. ltd.", " co. ltd", " co ltd", " company limited", " pte. ltd.", " pte. ltd", " pte ltd",
    " private limited", " incorporated", " corporation", " limited", " company", " gmbh", " s.a.", " s.a", " sa",
    " inc.", " inc", " corp.", " corp", " ltd.", " ltd", " llc", " co.", " co",
)
COMPANY_SUFFIXES_ZH = ("有限责任公司", "股份有限公司", "有限合伙", "合伙企业", "有限公司", "公司")


def aliases(table: dict[str, str]) -> dict[str, str]:
    return {alias: canonical for canonical, names in table.items() for alias in names.split()}


def lookup(key: Column, table: dict[str, str]) -> Column:
    """The canonical value of ``key``, or null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(aliases(table).items())]), key)


def letters_only(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{Alpha}\p{L}\p{N}]", "")


def tokens_joined(c: Column) -> Column:
    """Runs of letters and digits, joined by underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")


def degree(c: Column) -> Column:
    low = ascii_lower(F.trim(c))
    dotted = F.regexp_replace(low, r"[\p{Z}\s]+", "") == "b.e."
    return F.when(dotted, F.lit("bachelor")).otherwise(lookup(F.regexp_replace(low, r"[ .\-_]", ""), DEGREES))


def degree_rank(c: Column) -> Column:
    """Place of a canonical degree in the order, from 0."""
    return F.array_position(F.array(*[F.lit(d) for d in DEGREE_ORDER]), c) - 1


def degrees_from(least: str) -> list[str]:
    return list(DEGREE_ORDER[DEGREE_ORDER.index(least) :])


def school_tier(c: Column) -> Column:
    return lookup(letters_only(ascii_lower(F.trim(c))), SCHOOL_TIERS)


def skill(c: Column) -> Column:
    return F.coalesce(lookup(letters_only(folded(c)), SKILLS), folded(c))


def major(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.coalesce(lookup(F.regexp_replace(low, r"[ \-_]", ""), MAJORS), tokens_joined(c))


def company(c: Column) -> Column:
    """Without one English and then one Chinese suffix of legal form, the first in list order each."""
    out = folded(c)
    for suffixes in (COMPANY_SUFFIXES_EN, COMPANY_SUFFIXES_ZH):
        chosen = F.coalesce(*[F.when(out.endswith(s), F.lit(len(s))) for s in suffixes], F.lit(0))
        out = F.trim(F.substring(out, F.lit(1), F.length(out) - chosen))
    return out


def title(c: Column) -> Column:
    return F.coalesce(lookup(tokens_joined(c), TITLES), tokens_joined(c))


def location(c: Column) -> Column:
    primary = F.lower(fold_space(F.get(F.split(F.trim(c), r"[,，;；|/\\、]"), 0)))
    return F.coalesce(lookup(F.regexp_replace(primary, r"[ \-_]", ""), LOCATIONS), primary)


def certificate(c: Column) -> Column:
    return F.coalesce(lookup(tokens_joined(c), CERTIFICATES), tokens_joined(c))
