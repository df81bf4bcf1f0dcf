"""Small texts in six languages for tests."""

import random

SENTENCES = {
    "en": ["We followed {n} adults with dry eye for {n} months after surgery.", "The patient’s symptoms returned, and the dose was doubled – twice.", "A scan showed a thickness of {n} µm near the fovea.", "Costs came to €{n} per eye treated, or about £{n}.", "A naïve comparison would have missed those who never returned."],
    "zh": ["随访期间未见与用药有关的严重不良反应，仅有{n}例因刺痛而停药。", "基线眼压平均为{n}±2.02，末次随访时有所下降。", "两组最佳矫正视力的变化差异无统计学意义。", "图像由两名不了解分组的医师独立判读，意见不一致时由第三人裁定。", "检查发现中心凹附近厚度为{n} μm，边界清楚。"],
    "de": ["Wir haben {n} Augen von älteren Menschen über {n} Monate beobachtet.", "Bitte die Tropfen nicht gleichzeitig anwenden, sondern Abstand lassen.", "Die Kosten beliefen sich auf {n} € je Auge, Fahrten nicht mitgerechnet.", "Nach {n} Wochen kehrten die Beschwerden zurück und die Dosis wurde verdoppelt.", "Für die Hornhautdicke fanden wir keinen Unterschied zwischen den Gruppen."],
    "fr": ["Nous avons suivi {n} femmes âgées présentant une sécheresse de l’œil.", "Les images ont été lues par deux médecins qui ne connaissaient pas le traitement reçu.", "Aucun effet grave n’a été lié aux gouttes, mais {n} participants ont arrêté.", "Les résultats suggèrent que l’opération est sûre après la première année.", "Le coût était de {n} € par œil traité, sans compter les trajets."],
    "es": ["Seguimos a {n} niños en edad escolar con ojo seco durante {n} meses.", "Las molestias volvieron después de {n} semanas y se dobló la dosis.", "El coste fue de {n} € por ojo tratado, sin contar los viajes.", "Dos lectores que no conocían el tratamiento leyeron las imágenes.", "¿Cambia la presión del ojo después de la cirugía?"],
    "pt": ["Acompanhamos {n} mulheres grávidas com olho seco durante {n} meses.", "Os sintomas voltaram após {n} semanas e a dose foi dobrada.", "A variação da pressão do olho não foi diferente entre os dois grupos.", "São necessárias mais observações para uma conclusão.", "Dois leitores que não conheciam o tratamento avaliaram as imagens."],
}


def text(r: random.Random, language: str, n: int = 4) -> str:
    return ("" if language == "zh" else " ").join(r.choice(SENTENCES[language]).format(n=r.randrange(1, 900)) for _ in range(n))


def corpus(seed: int, n: int) -> list[tuple[str, str]]:
    r = random.Random(seed)
    return [(lang := r.choice([*SENTENCES, "en", "zh"]), text(r, lang, r.randrange(2, 7))) for _ in range(n)]
