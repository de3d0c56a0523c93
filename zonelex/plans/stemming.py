"""Stemmers by language, against pairs of words and stems."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stemmers import stem_with

#: Words with their stems, worked out by the published rules.
PAIRS = {
    "english": "consign consign consigned consign consigning consign consignment consign consist consist consistency consist consistent consist consolation consol "
    "consolatory consolatori knack knack knackeries knackeri knaves knave knavish knavish kneaded knead knell knell skies sky dying die generously generous "
    "communism communism happy happi by by say say news news hopping hop hoping hope ties tie cries cri gas gas this this relational relat",
    "swedish": "jaktkarl jaktkarl jaktkarlarne jaktkarl jakthorn jakthorn klockan klockan klockorna klock klokt klokt kloka klok",
    "norwegian": "havnedistrikt havnedistrikt havnedistriktene havnedistrikt havneeffektiv havneeffektiv opning opning opningen opning",
    "danish": "indtage indtag indtagelse indtag indtager indtag underste underst undersøgelse undersøg",
    "german": "aufeinander aufeinand aufeinanderfolge aufeinanderfolg kategorie kategori kategorien kategori kater kat katers kat katze katz katzen katz kätzchen katzch häuser haus",
    "spanish": "cheposo chepos chequea cheque chica chic chicharra chicharr torcer torc tórax torax chicago chicag rápidamente rapid naciones nacion cantábamos cant",
    "italian": "abbandonata abbandon abbandonate abbandon abbandonati abbandon pronto pront propaga propag nazionale nazional rapidamente rapid",
    "portuguese": "boa boa bola bol bombas bomb químicas químic quis quis nações naçõ rapidamente rapid",
    "french": "continu continu continua continu continuait continu continuant continu continuation continu contradiction contradict contradictoirement contradictoir "
    "majestueusement majestu majestueux majestu majorité major malades malad maladie malad maladies malad nationalité national évidemment évident",
    "dutch": "lichaamsziek lichaamsziek lichamelijk licham lichamelijke licham opgingen opging opglimlachen opglimlach mogelijkheden mogelijk",
    "russian": "в в вавиловка вавиловк вагнера вагнер важная важн важнее важн важнейшие важн важного важн важность важност вазы ваз",
    "finnish": "edeltäjien edeltäj edeltäjiinsä edeltäj edeltäjistään edeltäj edeltänyt edeltäny innostuessaan innostue innostuksen innostuks taloon talo talossa talo taloissa talo "
    "kirjoissa kirj kirjat kirj autoilla auto",
    "hungarian": "babakocsi babakocs babakocsijáért babakocs babakocsit babakocs házban ház házakat ház könyvekkel könyv almát alm késsel kés kezével kez",
    "romanian": "absolut absol absoluta absol absolută absol absent absent absentă absent lucrează lucr libertate libert naţiunea naţiun frumoasă frumoas",
    "indonesian": "membaca baca dibaca baca bacalah baca pembangunan bangun bukunya buku berlari lari makanan makan pelajaran ajar belajar ajar perbuatan buat menyapu sapu mengajarkan ajar",
    "irish": "bhfuil fuil chathair cathair gcapall capall n-athair athair feirmeoireacht feirmeoir t-uisce uisce mbád bád dtír tír",
    "hindi": "लड़का लड़क लड़के लड़क लड़कियां लड़क लड़कियों लड़क किताबें किताब बोलना बोल",
    "lithuanian": "namas nam namai nam namuose nam mergaitė mergait mergaite mergait mokytojas mok knygos knyg žodžiai žod",
    "arabic": "الكتاب كتاب كتابهم كتاب كتبوا كتب معلمون معلم القاهرة قاهر بالقلم قلم يستخدمون استخدم سيكتب يكتب على علي",
    "nepali": "घरको घर घरमा घर केटाहरु केटा केटीलाई केटी गरेको गर रामले राम",
}


def _query(language: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        words = spark.createDataFrame([(w,) for w in PAIRS[language].split()[::2]], "word string")
        return words.select("word", stem_with(F.col("word"), language).alias("stem"))

    return query


def _values(language: str) -> str:
    words = PAIRS[language].split()
    rows = ", ".join(f"('{w}', '{s}')" for w, s in zip(words[::2], words[1::2]))
    return f"SELECT * FROM (VALUES {rows}) AS v(word, stem)"


QUERIES = {f"stem_{language}": _query(language) for language in PAIRS}
ORACLE = {f"stem_{language}": _values(language) for language in PAIRS}
