"""Word lists that results depend on, as published or as the data format needs them."""

# Public lists of Taiwanese surnames, divisions, honorifics and legal suffixes; the order within a list matters only
# where values are drawn from it.
SURNAMES = "陳林黃張李王吳劉蔡楊許鄭謝洪郭邱曾廖賴徐周葉蘇莊江呂何蕭羅高簡朱鍾游沈彭曹宋歐"
TOP_SURNAMES = (
    "陳林黃張李王吳劉蔡楊許鄭謝洪郭邱曾廖賴徐周葉蘇莊呂江何蕭羅高潘簡朱鍾彭游詹胡施沈余盧梁趙顏柯翁魏孫戴"
    "范方宋鄧杜傅侯曹薛丁卓馬阮董唐温藍蔣石古紀姚連馮歐程湯田康黄姜白汪尤鄒黎巫鐘涂龔嚴韓袁金童陸柳凃夏邵"
)
GIVEN_CHARACTERS = "家文宇翔傑豪偉明智勇浩軒翊佳怡雅婷淑惠玲靜筠柔涵昀詩嘉彥承品恩宸睿芸瑄語心詠采岑小"
HONORIFICS = ("先生", "小姐", "女士")
DIVISIONS = (
    "台北市", "新北市", "桃園市", "台中市", "台南市", "高雄市", "基隆市", "新竹市", "嘉義市", "新竹縣", "苗栗縣",
    "彰化縣", "南投縣", "雲林縣", "嘉義縣", "屏東縣", "宜蘭縣", "花蓮縣", "台東縣", "澎湖縣", "金門縣", "連江縣",
)
DETECTED_SUFFIXES = ("股份有限公司", "有限公司", "診所", "事務所", "工作室", "基金會", "協會", "銀行", "醫院")

# What generated addresses and organizations are made of.
DISTRICTS = {
    "台北市": ("中正區", "大安區", "信義區", "士林區"),
    "新北市": ("板橋區", "三重區", "中和區", "新莊區"),
    "桃園市": ("桃園區", "中壢區", "八德區"),
    "台中市": ("西屯區", "北屯區", "南屯區"),
    "台南市": ("東區", "北區", "安平區"),
    "高雄市": ("三民區", "苓雅區", "鳳山區"),
    "新竹市": ("東區", "北區"),
    "基隆市": ("仁愛區", "信義區"),
}
ROADS = ("中山", "中正", "忠孝", "仁愛", "信義", "和平", "民生", "建國", "復興", "羅斯福")
ROAD_SUFFIXES = ("路", "街")
ORG_WORDS = ("誠信", "昇陽", "啟明", "華夏", "匯通", "立信", "協和", "廣益", "集賢", "泰安")
ORG_SUFFIXES = ("股份有限公司", "有限公司", "診所", "事務所", "工作室", "基金會", "協會")

# Sentence frames: id, scenario, text with slots.
TEMPLATES = (
    ("cs_01", "customer_service", "您好，我是{PERSON}，想詢問訂單狀態。"),
    ("cs_02", "customer_service", "客戶{PERSON}來電反映，居住地址為{ADDRESS}，請盡快處理。"),
    ("cs_03", "customer_service", "{PERSON}的包裹已送達{ADDRESS}，如有疑問請聯繫{ORG}客服。"),
    ("ad_01", "admin", "申請人：{PERSON}。"),
    ("ad_02", "admin", "本案由{ORG}承辦，聯絡人為{PERSON}。"),
    ("ad_03", "admin", "{PERSON}的戶籍地址登記為{ADDRESS}，特此公告。"),
    ("fi_01", "finance", "匯款人{PERSON}，請確認收款帳戶無誤。"),
    ("fi_02", "finance", "{ORG}已將款項匯至{PERSON}的帳戶，地址核對為{ADDRESS}。"),
    ("fi_03", "finance", "本月請款單位：{ORG}。"),
    ("md_01", "medical", "病患{PERSON}預約於明日回診。"),
    ("md_02", "medical", "{PERSON}的聯絡地址為{ADDRESS}，看診科別為家醫科。"),
    ("rc_01", "recruiting", "應徵者{PERSON}投遞了{ORG}的職缺。"),
    ("rc_02", "recruiting", "姓名：{PERSON}。"),
    ("rc_03", "recruiting", "{ORG}人資部門將聯繫{PERSON}安排面試，地點：{ADDRESS}。"),
    ("neg_01", "logistics", "訂單編號{ORDER_NO}已出貨，預計{DATE}送達，金額{AMOUNT}。"),
    ("neg_02", "logistics", "本次活動日期為{DATE}，報名人數上限{NUMBER}人，費用{AMOUNT}。"),
    ("neg_03", "logistics", "產品編號{PRODUCT_CODE}，庫存數量{NUMBER}件，到貨日{DATE}。"),
)
# Chances of the four kinds of noise by tier: strip, honorific, fullwidth, partial address.
NOISE = {"easy": (0.0, 0.0, 0.0, 0.0), "medium": (0.4, 0.4, 0.4, 0.0), "hard": (0.8, 0.7, 0.8, 0.6), "negative": (0.15, 0.0, 0.3, 0.0)}
TIER_COUNTS = {"easy": 80, "medium": 100, "hard": 70, "negative": 50}

# Characters that text noise deletes, and those that end an address or organization match.
STRIPPED = " \t，。：；、！？,.:;!?"
PUNCTUATION = "，。：；、！？,.:;!?"
