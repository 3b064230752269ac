"""Values that must equal the ones the original data and models were made with."""

# --- fixed values: English class name -> Arabic class name -------------------
CLASS_NAMES_AR = {
    "baby care": "العناية بالرضع",
    "bakery": "المخبوزات",
    "beef lamb meat": "لحم البقر والضأن",
    "beef processed meat": "لحم البقر واللحوم المصنعة",
    "biscuits cakes": "البسكويت والكيك",
    "candles air fresheners": "الشموع ومعطرات الجو",
    "chips crackers": "رقائق البطاطس والمقرمشات",
    "chocolates sweets desserts": "الشوكولاتة والحلويات والحلويات الجاهزة",
    "cleaning supplies": "مستلزمات التنظيف",
    "condiments dressings marinades": "التوابل والصلصات والمخللات",
    "cooking ingredients": "مكونات الطبخ",
    "dairy eggs": "الألبان والبيض",
    "disposables napkins": "المنتجات أحادية الاستخدام والمناديل",
    "fruits": "الفواكه",
    "furniture": "الأثاث",
    "hair shower bath soap": "العناية بالشعر والاستحمام والصابون",
    "home appliances": "الأجهزة المنزلية",
    "home textile": "المنسوجات المنزلية",
    "jams spreads syrups": "المربى والدهن والشراب",
    "nuts dates dried fruits": "المكسرات والتمر والفواكه المجففة",
    "personal care skin body care": "العناية الشخصية والعناية بالبشرة والجسم",
    "poultry": "الدواجن",
    "rice pasta pulses": "الأرز والمعكرونة والبقوليات",
    "sauces dressings condiments": "الصلصات والتتبيلات والتوابل",
    "soft drinks juices": "المشروبات الغازية والعصائر",
    "sweets desserts": "الحلويات والتحليات",
    "tea and coffee": "الشاي والقهوة",
    "tea coffee hot drinks": "الشاي والقهوة والمشروبات الساخنة",
    "tins jars packets": "المعلبات والعبوات",
    "vegetables fruits": "الخضروات والفواكه",
    "vegetables herbs": "الخضروات والأعشاب",
    "water": "المياه",
    "laundry detergents": "الغسيل والمنظفات",
    "sugar home baking": "السكر والمخبوزات المنزلية",
    "perfumes deodorants": "العطور ومزيلات العرق",
    "stationary": "اللوازم المكتبية",
    "breakfast cereals bars": "ألواح حبوب الإفطار",
    "dental care": "العناية بالأسنان",
    "fish": "الأسماك",
    "footwear": "الأحذية",
    "mobile tablets": "الأجهزة اللوحية",
    "party supplies and gifts": "مستلزمات الحفلات والهدايا",
    "pets care": "العناية بالحيوانات الأليفة",
    "wear": "الملابس",
}

# --- fixed values: placeholders of the prompt template -----------------------
PROMPT_NAME_SLOT = "{{Product_Name}}"
PROMPT_LABELS_SLOT = "{{LABEL_1}}\n{{LABEL_2}}\n{{LABEL_3}}\n{{LABEL_4}}\n{{LABEL_5}}\n...."
PREFIX_TEXT_SLOT = "{text}"

# --- fixed values: taxonomy ---------------------------------------------------
LEVELS = ("segment", "family", "class", "brick")
PATH_SEPARATOR = "::"
TAXONOMY_COLUMNS_DROPPED = (
    "SegmentCode",
    "FamilyCode",
    "ClassCode",
    "BrickCode",
    "AttributeCode",
    "AttributeTitle",
    "AttributeDefinition",
    "AttributeValueCode",
    "AttributeValueTitle",
    "AttributeValueDefinition",
)
TAXONOMY_COLUMNS_CLEANED = (
    "SegmentTitle",
    "SegmentDefinition",
    "FamilyTitle",
    "FamilyDefinition",
    "ClassTitle",
    "ClassDefinition",
    "BrickTitle",
    "BrickDefinition_Includes",
    "BrickDefinition_Excludes",
)
# --- fixed values: model parameters -------------------------------------------
VOTE_WEIGHTS = {"tfidf": 0.3, "cosine": 0.4, "answer": 0.3}
TOP_K = 3
TRANSLATION_BATCH = 32
UPLOAD_BATCH = 5000
LABELLING_BATCH = 50
MAX_CONSECUTIVE_FAILURES = 3
SPLIT_SEED = 42
TEST_SHARE = 0.2
RUN_STAMP_FORMAT = "yyyyMMdd_HHmmss"
