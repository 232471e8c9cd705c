"""Seed lexicons. Real dictionaries are parameters: any table of the same columns can replace a seed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Letter names in ARPABET ("a" as a letter is its second reading), the clitic, words that are always spelled.
LETTER_NAMES = {
    "a": "EY1", "b": "B IY1", "c": "S IY1", "d": "D IY1", "e": "IY1", "f": "EH1 F", "g": "JH IY1", "h": "EY1 CH", "i": "AY1", "j": "JH EY1",
    "k": "K EY1", "l": "EH1 L", "m": "EH1 M", "n": "EH1 N", "o": "OW1", "p": "P IY1", "q": "K Y UW1", "r": "AA1 R", "s": "EH1 S", "t": "T IY1",
    "u": "Y UW1", "v": "V IY1", "w": "D AH1 B AH0 L Y UW0", "x": "EH1 K S", "y": "W AY1", "z": "Z IY1",
}
CLITICS = {"n't": "AH0 N T"}
FORCE_SPELLINGS = ["AE", "AI", "AR", "IOS", "HUD", "OS"]

#: Common words, written for this library; readings in order, the first is the default.
ENGLISH_SEED = {
    "a": ["AH0", "EY1"], "an": ["AE1 N"], "and": ["AH0 N D", "AE1 N D"], "are": ["AA1 R"], "as": ["AE1 Z"], "at": ["AE1 T"], "be": ["B IY1"],
    "by": ["B AY1"], "for": ["F AO1 R"], "from": ["F R AH1 M"], "have": ["HH AE1 V"], "he": ["HH IY1"], "hello": ["HH AH0 L OW1"], "in": ["IH0 N"],
    "is": ["IH1 Z"], "it": ["IH1 T"], "not": ["N AA1 T"], "of": ["AH1 V"], "on": ["AA1 N"], "or": ["AO1 R"], "that": ["DH AE1 T"],
    "the": ["DH AH0", "DH IY0"], "they": ["DH EY1"], "this": ["DH IH1 S"], "to": ["T UW1", "T AH0"], "was": ["W AA1 Z"], "with": ["W IH1 DH"],
    "world": ["W ER1 L D"], "you": ["Y UW1"], "record": ["R AH0 K AO1 R D", "R EH1 K ER0 D"], "refuse": ["R AH0 F Y UW1 Z", "R EH1 F Y UW2 Z"],
    "python": ["P AY1 TH AA0 N"], "cafe": ["K AH0 F EY1"], "test": ["T EH1 S T"], "worthless": ["W ER1 TH L AH0 S"], "idiot": ["IH1 D IY0 AH0 T"],
    "clown": ["K L AW1 N"], "loser": ["L UW1 Z ER0"], "pathetic": ["P AH0 TH EH1 T IH0 K"], "moron": ["M AO1 R AA2 N"], "license": ["L AY1 S AH0 N S"],
    "public": ["P AH1 B L IH0 K"], "work": ["W ER1 K"], "general": ["JH EH1 N ER0 AH0 L"], "under": ["AH1 N D ER0"], "version": ["V ER1 ZH AH0 N"],
    "ai": ["AY1"], "os": ["AO1 S"],
}
#: word: reading where the tag starts with the prefix, other reading, prefix.
HOMOGRAPHS = {"record": ("R AH0 K AO1 R D", "R EH1 K ER0 D", "V"), "refuse": ("R IH0 F Y UW1 Z", "R EH1 F Y UW1 S", "V")}

#: Readings of some Han characters, written for this library; Mandarin in numbered pinyin, then Cantonese in Jyutping.
HAN_SEED = {
    "不": ("bu4", "bat1"), "一": ("yi1", "jat1"), "二": ("er4", "ji6"), "三": ("san1", "saam1"), "四": ("si4", "sei3"), "五": ("wu3", "ng5"),
    "六": ("liu4", "luk6"), "七": ("qi1", "cat1"), "八": ("ba1", "baat3"), "九": ("jiu3", "gau2"), "十": ("shi2", "sap6"), "百": ("bai3", "baak3"),
    "千": ("qian1", "cin1"), "万": ("wan4", "maan6"), "零": ("ling2", "ling4"), "年": ("nian2", "nin4"), "月": ("yue4", "jyut6"), "日": ("ri4", "jat6"),
    "你": ("ni3", "nei5"), "好": ("hao3,hao4", "hou2"), "我": ("wo3", "ngo5"), "他": ("ta1", "taa1"), "们": ("men5", "mun4"), "是": ("shi4", "si6"),
    "的": ("de5,di4", "dik1"), "了": ("le5,liao3", "liu5"), "着": ("zhe5,zhao2", "zoek6"), "过": ("guo4", "gwo3"), "看": ("kan4,kan1", "hon3"),
    "想": ("xiang3", "soeng2"), "去": ("qu4", "heoi3"), "来": ("lai2", "loi4"), "大": ("da4", "daai6"), "小": ("xiao3", "siu2"), "人": ("ren2", "jan4"),
    "中": ("zhong1,zhong4", "zung1"), "文": ("wen2", "man4"), "国": ("guo2", "gwok3"), "学": ("xue2", "hok6"), "生": ("sheng1", "saang1"),
    "长": ("chang2,zhang3", "coeng4"), "为": ("wei4,wei2", "wai6"), "行": ("xing2,hang2", "hang4"), "重": ("zhong4,chong2", "cung5"),
    "点": ("dian3", "dim2"), "分": ("fen1", "fan1"), "号": ("hao4", "hou6"), "米": ("mi3", "mai5"), "百分": ("bai3 fen1", "baak3 fan1"),
    "儿": ("er2", "ji4"), "吧": ("ba5", "baa6"), "啊": ("a5", "aa3"), "呢": ("ne5", "ne1"), "第": ("di4", "dai6"), "初": ("chu1", "co1"),
    "很": ("hen3", "han2"), "楼": ("lou2", "lau4"), "班": ("ban1", "baan1"), "连": ("lian2", "lin4"), "水": ("shui3", "seoi2"), "手": ("shou3", "sau2"),
    "老": ("lao3", "lou5"), "鼠": ("shu3", "syu2"), "展": ("zhan3", "zin2"), "览": ("lan3", "laam5"), "馆": ("guan3", "gun2"), "世": ("shi4", "sai3"),
    "界": ("jie4", "gaai3"), "银": ("yin2", "ngan4"), "快": ("kuai4", "faai3"), "乐": ("le4,yue4", "lok6"), "微": ("wei1", "mei4"), "克": ("ke4", "hak1"), "负": ("fu4", "fu6"), "之": ("zhi1", "zi1"), "幺": ("yao1", "jiu1"), "家": ("jia1", "gaa1"), "妈": ("ma1", "maa1"),
}
#: Phrases whose readings differ from those of their characters.
PHRASE_SEED = {"差旅": "chai1 lv3", "乐亭": "lao4 ting2", "和泥抹墙": "huo2 ni2 mo3 qiang2", "银行": "yin2 hang2", "长大": "zhang3 da4", "重来": "chong2 lai2", "快乐": "kuai4 le4", "妈妈": "ma1 ma5"}

#: Simplified characters with one traditional form, and those forms: a seed, the full table is a parameter.
TRADITIONAL = dict(
    zip(
        "国学长们银乐妈爱办报备边变标别宾财参产场车称诚处传创从达带单当导电东动对队发风复够关观广归规还汉号红话怀坏欢环会机级极计记际间见将讲节结进经旧举觉开课来离礼历丽连联两辆疗邻龙楼录买卖满门难脑农欧盘评齐气钱强亲轻请庆热认三伤设声师时实识书树帅双说虽岁孙体条听头图团万围为伟卫稳问无习细显现县线乡响写兴选训亚严样阳养药爷业医艺亿义议忆译应营拥优邮鱼语员园远愿约云运杂责张阵证织职纸钟种众专转庄壮准资总组点个",
        "國學長們銀樂媽愛辦報備邊變標別賓財參產場車稱誠處傳創從達帶單當導電東動對隊發風復夠關觀廣歸規還漢號紅話懷壞歡環會機級極計記際間見將講節結進經舊舉覺開課來離禮歷麗連聯兩輛療鄰龍樓錄買賣滿門難腦農歐盤評齊氣錢強親輕請慶熱認三傷設聲師時實識書樹帥雙說雖歲孫體條聽頭圖團萬圍為偉衛穩問無習細顯現縣線鄉響寫興選訓亞嚴樣陽養藥爺業醫藝億義議憶譯應營擁優郵魚語員園遠願約雲運雜責張陣證織職紙鐘種眾專轉莊壯準資總組點個",
        strict=True,
    )
)

# Word lists of tone sandhi.
SANDHI_WHITELIST = ["女儿", "妻儿", "胎儿", "婴儿", "幼儿", "少儿", "小儿", "孤儿", "新生儿", "婴幼儿"]
INTERJECTIONS = ["吧", "呢", "啊", "呐", "噻", "嘛", "吖", "嗨", "哦", "哒", "滴", "哩", "哟", "喽", "啰", "耶", "喔", "诶"]
DIGITS = ["零", "一", "二", "三", "四", "五", "六", "七", "八", "九", "十", "百", "千", "万", "亿"]
#: Words that end in a neutral tone: a seed, the full list is a parameter.
NEUTRAL_SEED = ["妈妈", "爸爸", "哥哥", "姐姐", "弟弟", "妹妹", "东西", "朋友", "什么", "怎么", "知道", "地方", "先生", "学生", "时候", "意思", "明白", "漂亮", "客气", "麻烦"]

#: Tags of some words, for homographs; anything else goes by rules.
TAG_SEED = {"the": "DT", "a": "DT", "an": "DT", "this": "DT", "my": "PRP$", "your": "PRP$", "to": "TO", "i": "PRP", "you": "PRP", "we": "PRP", "they": "PRP", "he": "PRP", "she": "PRP", "will": "MD", "can": "MD", "must": "MD", "please": "UH", "new": "JJ", "old": "JJ"}


def english(spark: SparkSession) -> DataFrame:
    """word, readings (in order), without the words that are always spelled."""
    forced = {w.lower() for w in FORCE_SPELLINGS}
    return spark.createDataFrame([(w, r) for w, r in ENGLISH_SEED.items() if w not in forced], "word string, readings array<string>")


def han(spark: SparkSession) -> DataFrame:
    """char, mandarin (readings in order), cantonese."""
    return spark.createDataFrame([(c, m.split(","), y) for c, (m, y) in HAN_SEED.items() if len(c) == 1], "char string, mandarin array<string>, cantonese string")
