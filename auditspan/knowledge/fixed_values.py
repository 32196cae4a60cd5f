"""Fixed values the audit results depend on.

Everything in this module is a constant of the problem domain: check ids and
severities, fine amounts, service domains, word stems and text patterns.  The
values are stated plainly so they can be reviewed, or replaced by loading other
tables through :mod:`auditspan.sources.dimensions`.
"""
from __future__ import annotations

# ---------------------------------------------------------------------------
# Site checklist
# (check_id, category, severity, fine_id, method, title, law, recommendation)
# ---------------------------------------------------------------------------
CHECKLIST = (
    ('FORM_001', 'forms', 'critical', 'FS-003', 'html_check',
     'Чекбокс согласия на обработку ПДн', 'ст. 9 ч. 1 152-ФЗ',
     'Добавить чекбокс согласия на обработку ПДн рядом с каждой формой, собирающей персональные данные.'),
    ('FORM_002', 'forms', 'high', 'FS-003', 'html_check',
     'Чекбокс согласия не отмечен по умолчанию', 'ст. 9 ч. 1 152-ФЗ',
     'Убрать атрибут checked у чекбокса согласия.'),
    ('FORM_003', 'forms', 'high', 'FS-003', 'html_check',
     'Ссылка на Политику обработки ПДн рядом с формой', 'ст. 18.1 152-ФЗ',
     'Добавить ссылку на Политику обработки ПДн рядом с чекбоксом согласия.'),
    ('FORM_004', 'forms', 'medium', 'FS-003', 'html_check',
     'Кнопка отправки отключена до согласия', 'ст. 9 ч. 1 152-ФЗ',
     'Реализовать блокировку кнопки отправки формы до установки чекбокса согласия.'),
    ('FORM_005', 'forms', 'high', 'FS-003', 'html_check',
     'Согласие — отдельный документ', 'ст. 9 152-ФЗ (ред. 156-ФЗ от 01.09.2025)',
     'Оформить согласие на обработку ПДн как отдельный документ/страницу.'),
    ('FORM_006', 'forms', 'medium', 'FS-003', 'html_check',
     'Отдельный чекбокс для маркетинговых рассылок', 'ст. 15 152-ФЗ, ст. 18 ФЗ-38 «О рекламе»',
     'Добавить отдельный чекбокс для согласия на получение маркетинговых материалов.'),
    ('FORM_007', 'forms', 'medium', 'FS-003', 'html_check',
     'Минимальный объём собираемых данных', 'ст. 5 ч. 5 152-ФЗ',
     'Убрать из формы поля, не необходимые для заявленной цели обработки.'),
    ('FORM_008', 'forms', 'high', 'FS-003', 'html_check',
     'Идентификация оператора в согласии', 'ст. 9 ч. 4 152-ФЗ',
     'Указать в тексте согласия наименование и ИНН оператора.'),
    ('COOKIE_001', 'cookies', 'high', 'FS-008', 'browser_check',
     'Cookie-баннер при первом визите', 'ст. 9 152-ФЗ, 420-ФЗ',
     'Установить cookie-баннер, отображаемый при первом визите.'),
    ('COOKIE_002', 'cookies', 'medium', 'FS-008', 'browser_check',
     'Кнопка «Отклонить» в cookie-баннере', 'ст. 9 152-ФЗ',
     'Добавить кнопку «Отклонить» рядом с «Принять» в cookie-баннере.'),
    ('COOKIE_003', 'cookies', 'medium', 'FS-008', 'browser_check',
     'Аналитические/маркетинговые cookie выключены по умолчанию', 'ст. 9 152-ФЗ',
     'Реализовать управление категориями cookie с выключенными по умолчанию аналитическими/маркетинговыми cookie.'),
    ('COOKIE_004', 'cookies', 'low', 'FS-008', 'browser_check',
     'Ссылка на Cookie Policy в баннере', 'ст. 18.1 152-ФЗ',
     'Добавить ссылку на политику использования cookie в баннер.'),
    ('COOKIE_005', 'cookies', 'high', 'FS-009', 'network_check',
     'Аналитика не загружается до согласия', 'ст. 9 152-ФЗ',
     'Загружать аналитические скрипты только после получения согласия на cookie.'),
    ('COOKIE_006', 'cookies', 'low', 'FS-008', 'browser_check',
     'Сохранение предпочтений cookie', 'ст. 9 152-ФЗ',
     'Реализовать сохранение пользовательских предпочтений по cookie.'),
    ('POLICY_001', 'privacy_policy', 'critical', 'FS-010', 'html_check',
     'Политика обработки ПДн опубликована', 'ст. 18.1 152-ФЗ',
     'Опубликовать Политику обработки ПДн в общедоступном месте на сайте.'),
    ('POLICY_002', 'privacy_policy', 'medium', 'FS-010', 'html_check',
     'Ссылка на Политику в футере каждой страницы', 'ст. 18.1 152-ФЗ',
     'Добавить ссылку на Политику в футер шаблона сайта.'),
    ('POLICY_003', 'privacy_policy', 'high', 'FS-010', 'text_search',
     'Полное наименование оператора', 'ст. 18.1 152-ФЗ',
     'Указать полное наименование юридического лица или ИП.'),
    ('POLICY_004', 'privacy_policy', 'high', 'FS-010', 'text_search',
     'ИНН/ОГРН и адрес оператора', 'ст. 18.1 152-ФЗ',
     'Указать ИНН, ОГРН и юридический адрес оператора.'),
    ('POLICY_005', 'privacy_policy', 'high', 'FS-010', 'text_search',
     'Ответственный за обработку ПДн', 'ст. 22.1 152-ФЗ',
     'Указать ФИО и контактные данные ответственного за обработку ПДн.'),
    ('POLICY_006', 'privacy_policy', 'high', 'FS-010', 'text_search',
     'Категории персональных данных', 'ст. 18.1 152-ФЗ',
     'Перечислить все категории обрабатываемых персональных данных.'),
    ('POLICY_007', 'privacy_policy', 'high', 'FS-010', 'text_search',
     'Цели обработки для каждой категории', 'ст. 5 ч. 2 152-ФЗ',
     'Указать цели обработки для каждой категории персональных данных.'),
    ('POLICY_008', 'privacy_policy', 'high', 'FS-010', 'text_search',
     'Правовые основания обработки', 'ст. 6 152-ФЗ',
     'Указать правовые основания для каждого вида обработки ПДн.'),
    ('POLICY_009', 'privacy_policy', 'high', 'FS-010', 'text_search',
     'Сроки хранения данных', 'ст. 5 ч. 7 152-ФЗ',
     'Указать сроки хранения или критерии определения сроков для каждой категории данных.'),
    ('POLICY_010', 'privacy_policy', 'high', 'FS-010', 'text_search',
     'Права субъектов ПДн', 'ст. 14 152-ФЗ',
     'Описать права субъектов ПДн и механизмы их реализации.'),
    ('POLICY_011', 'privacy_policy', 'high', 'FS-010', 'text_search',
     'Порядок реализации прав (10 рабочих дней)', 'ст. 14 ч. 4 152-ФЗ',
     'Указать контакт для обращений и срок ответа — 10 рабочих дней.'),
    ('POLICY_012', 'privacy_policy', 'high', 'FS-010', 'text_search',
     'Информация о трансграничной передаче', 'ст. 12 152-ФЗ',
     'Указать страны, получателей, цели и основания трансграничной передачи.'),
    ('POLICY_013', 'privacy_policy', 'medium', 'FS-010', 'text_search',
     'Описание мер безопасности', 'ст. 19 152-ФЗ',
     'Описать принимаемые меры безопасности (без раскрытия техдеталей).'),
    ('POLICY_014', 'privacy_policy', 'medium', 'FS-010', 'text_search',
     'Информация о cookies', 'ст. 18.1 152-ФЗ',
     'Добавить раздел о cookies или отдельный документ Cookie Policy.'),
    ('POLICY_015', 'privacy_policy', 'critical', 'FS-010', 'text_search',
     'Заявление о локализации данных в РФ', 'ст. 18 ч. 5 152-ФЗ',
     'Добавить заявление о локализации баз данных на территории РФ.'),
    ('POLICY_016', 'privacy_policy', 'medium', 'FS-010', 'text_search',
     'Дата публикации и обновления', 'ст. 18.1 152-ФЗ',
     'Указать дату публикации и последнего обновления Политики.'),
    ('POLICY_017', 'privacy_policy', 'high', 'FS-010', 'text_search',
     'Документ на русском языке', 'ст. 18.1 152-ФЗ',
     'Обеспечить наличие полной версии Политики на русском языке.'),
    ('TECH_001', 'technical', 'critical', 'FS-007', 'network_check',
     'HTTPS на всех страницах', 'ст. 19 ч. 1 152-ФЗ',
     'Установить SSL-сертификат и настроить перенаправление HTTP на HTTPS.'),
    ('TECH_002', 'technical', 'high', 'FS-007', 'network_check',
     'Отсутствие Google Fonts с серверов Google', 'ч. 5 ст. 18 152-ФЗ, 420-ФЗ',
     'Скачать шрифты и разместить локально на сервере.'),
    ('TECH_003', 'technical', 'critical', 'FS-007', 'network_check',
     'Отсутствие Google Analytics', 'ч. 5 ст. 18 152-ФЗ, 420-ФЗ',
     'Удалить Google Analytics, перейти на Яндекс.Метрику.'),
    ('TECH_004', 'technical', 'critical', 'FS-007', 'network_check',
     'Отсутствие Facebook Pixel', 'ч. 5 ст. 18 152-ФЗ',
     'Удалить Facebook Pixel, использовать VK Pixel или Яндекс.Аудитории.'),
    ('TECH_005', 'technical', 'high', 'FS-007', 'network_check',
     'Отсутствие Google reCAPTCHA', 'ч. 5 ст. 18 152-ФЗ, 420-ФЗ',
     'Заменить на Яндекс SmartCaptcha.'),
    ('TECH_006', 'technical', 'high', 'FS-007', 'network_check',
     'Отсутствие Google Tag Manager', 'ч. 5 ст. 18 152-ФЗ, 420-ФЗ',
     'Удалить GTM, подключать скрипты напрямую.'),
    ('REG_001', 'regulatory', 'critical', 'FS-001', 'manual',
     'Оператор зарегистрирован в реестре РКН', 'ст. 22 ч. 1 152-ФЗ',
     'Подать уведомление через портал pd.rkn.gov.ru.'),
    ('REG_002', 'regulatory', 'critical', 'FS-001', 'manual',
     'Уведомление об обработке ПДн подано', 'ст. 22 ч. 1-3 152-ФЗ',
     'Подать уведомление с актуальными сведениями через pd.rkn.gov.ru.'),
    ('REG_003', 'regulatory', 'critical', 'FS-001', 'manual',
     'Хостинг на территории РФ', 'ст. 18 ч. 5 152-ФЗ',
     'Убедиться, что хостинг-провайдер размещает серверы в РФ.'),
    ('TRACKER_001', 'trackers', 'high', 'FS-007', 'network_check',
     'Трекер без упоминания в политике', 'ст. 9, ст. 18.1 152-ФЗ',
     'Добавить описание всех используемых трекеров в политику конфиденциальности с указанием целей обработки'),
    ('TRACKER_002', 'trackers', 'critical', 'FS-003', 'browser_check',
     'Трекер без согласия пользователя', 'ч. 2 ст. 13.11 КоАП РФ',
     'Реализовать загрузку трекеров только после получения явного согласия пользователя'),
    ('CONSENT_001', 'consent', 'critical', 'FS-003', 'html_check',
     'Наличие согласия на обработку ПДн', 'ст. 9 152-ФЗ, ч. 2 ст. 13.11 КоАП РФ',
     'Добавить чекбокс согласия на обработку ПДн рядом с каждой формой сбора данных'),
    ('CONSENT_002', 'consent', 'critical', 'FS-003', 'html_check',
     'Согласие отделено от оферты', 'ст. 9 ч. 8 152-ФЗ (ред. 01.09.2025)',
     'Вынести согласие на обработку ПДн в отдельный документ/страницу, убрать из текста оферты'),
    ('CONSENT_003', 'consent', 'high', 'FS-003', 'text_search',
     'Обязательные реквизиты в тексте согласия', 'ст. 9 ч. 4 152-ФЗ',
     'Дополнить текст согласия обязательными реквизитами: оператор, цели, перечень ПДн, сроки, порядок отзыва'),
    ('CONSENT_004', 'consent', 'high', 'FS-003', 'text_search',
     'Возможность отзыва согласия', 'ст. 9 ч. 2 152-ФЗ',
     'Добавить в текст согласия или на сайт инструкцию по отзыву согласия с контактными данными'),
    ('CONSENT_005', 'consent', 'high', 'FS-003', 'html_check',
     'Раздельные согласия для разных целей', 'ст. 9 ч. 8 152-ФЗ (ред. 01.09.2025)',
     'Разделить согласия: отдельный чекбокс для обработки ПДн в целях оказания услуг, отдельный — для маркетинговых рассылок'),
)

# ---------------------------------------------------------------------------
# Fine schedule, whole roubles
# (fine_id, violation, law, first offence min, first offence max, repeat max)
# ---------------------------------------------------------------------------
FINES = (
    ('FS-001', 'Неуведомление Роскомнадзора об обработке ПДн', 'ч. 1 ст. 13.11 КоАП РФ', 100000, 300000, 500000),
    ('FS-002', 'Подача некорректного уведомления в Роскомнадзор', 'ч. 1 ст. 13.11 КоАП РФ', 100000, 300000, 500000),
    ('FS-003', 'Обработка ПДн без согласия субъекта', 'ч. 2 ст. 13.11 КоАП РФ', 300000, 700000, 1500000),
    ('FS-004', 'Утечка персональных данных', 'ч. 12-14 ст. 13.11 КоАП РФ', 3000000, 15000000, None),
    ('FS-005', 'Утечка биометрических ПДн', 'ч. 15 ст. 13.11 КоАП РФ', 15000000, 20000000, None),
    ('FS-006', 'Неуведомление РКН об инциденте утечки данных', 'ч. 16 ст. 13.11 КоАП РФ', 1000000, 3000000, None),
    ('FS-007', 'Использование запрещённых зарубежных сервисов на сайте', 'ч. 9-11 ст. 13.11 КоАП РФ', 1000000, 6000000, 18000000),
    ('FS-008', 'Отсутствие cookie-баннера', 'ч. 2 ст. 13.11 КоАП РФ', 150000, 300000, 500000),
    ('FS-009', 'Cookie с чувствительными данными без согласия', 'ч. 2 ст. 13.11 КоАП РФ', 300000, 700000, 1500000),
    ('FS-010', 'Непубликация или неполнота политики обработки ПДн', 'ч. 8 ст. 13.11 КоАП РФ', 30000, 60000, 100000),
)

# ---------------------------------------------------------------------------
# Prohibited services, in match order
# (name, type, fine_id, domains)
# ---------------------------------------------------------------------------
PROHIBITED_SERVICES = (
    ('Google Analytics', 'analytics', 'FS-007', ('google-analytics.com', 'www.google-analytics.com', 'ssl.google-analytics.com', 'analytics.google.com')),
    ('Google Tag Manager', 'tag_manager', 'FS-007', ('www.googletagmanager.com', 'googletagmanager.com', 'tagmanager.google.com')),
    ('Google Fonts', 'fonts', 'FS-007', ('fonts.googleapis.com', 'fonts.gstatic.com')),
    ('Google reCAPTCHA', 'captcha', 'FS-007', ('www.google.com/recaptcha', 'recaptcha.google.com', 'www.recaptcha.net', 'www.gstatic.com/recaptcha')),
    ('Google Maps', 'maps', 'FS-007', ('maps.googleapis.com', 'maps.google.com', 'www.google.com/maps')),
    ('Facebook Pixel', 'pixel', 'FS-007', ('connect.facebook.net', 'www.facebook.com/tr', 'pixel.facebook.com')),
    ('Cloudflare Analytics', 'analytics', 'FS-007', ('static.cloudflareinsights.com', 'cloudflareinsights.com')),
    ('HubSpot Tracking', 'analytics', 'FS-007', ('js.hs-scripts.com', 'track.hubspot.com', 'js.hsforms.net', 'js.hs-analytics.net')),
    ('Intercom', 'analytics', 'FS-007', ('widget.intercom.io', 'api-iam.intercom.io', 'js.intercomcdn.com')),
    ('Hotjar', 'analytics', 'FS-007', ('static.hotjar.com', 'script.hotjar.com', 'vars.hotjar.com')),
    ('Mixpanel', 'analytics', 'FS-007', ('cdn.mxpnl.com', 'api.mixpanel.com', 'api-js.mixpanel.com')),
    ('Segment', 'analytics', 'FS-007', ('cdn.segment.com', 'api.segment.io', 'cdn.segment.io')),
)

# ---------------------------------------------------------------------------
# Tracker registry, in report order
# (name, domains, policy keywords, is_foreign)
# ---------------------------------------------------------------------------
TRACKERS = (
    ("Google Analytics", ("google-analytics.com", "analytics.google.com"),
     ("google analytics", "гугл аналитика", "google anal"), True),
    ("Google Tag Manager", ("googletagmanager.com",),
     ("google tag manager", "gtm", "googletagmanager"), True),
    ("Meta Pixel", ("connect.facebook.net", "facebook.com", "fbcdn.net"),
     ("facebook", "meta pixel", "fb pixel", "фейсбук", "мета пиксель"), True),
    ("TikTok Pixel", ("analytics.tiktok.com", "tiktok.com"), ("tiktok", "тикток"), True),
    ("Tawk.to", ("tawk.to", "embed.tawk.to"), ("tawk", "tawk.to"), True),
    ("Zendesk", ("zendesk.com", "zdassets.com", "zopim.com"), ("zendesk", "зендеск"), True),
    ("LiveChat", ("livechatinc.com", "cdn.livechatinc.com"),
     ("livechat", "лайвчат", "livechatinc"), True),
    ("WhatsApp Business", ("whatsapp.com", "whatsapp.net"),
     ("whatsapp", "вотсап", "ватсап"), True),
    ("Typeform", ("typeform.com", "embed.typeform.com"), ("typeform", "тайпформ"), True),
    ("Jotform", ("jotform.com",), ("jotform", "джотформ"), True),
    ("Яндекс.Метрика", ("mc.yandex.ru", "mc.yandex.com", "metrika.yandex.ru"),
     ("яндекс.метрика", "яндекс метрика", "yandex metrika", "yandex.metrika"), False),
    ("VK Pixel", ("vk.com", "vkontakte.ru"),
     ("вконтакте", "vk pixel", "вк пиксель", "myTarget", "mytarget"), False),
    ("JivoChat", ("jivosite.com", "jivo.ru"),
     ("jivosite", "jivochat", "живосайт", "jivo"), False),
)

# ---------------------------------------------------------------------------
# Known legal updates
# (id, date, effective_date, source, title, severity, category, articles,
#  affected document types)
# ---------------------------------------------------------------------------
LEGAL_UPDATES = (
    ('LU-2025-001', '2025-07-01', '2025-07-01', 'Федеральный закон от 14.07.2022 № 266-ФЗ',
     'Запрет использования зарубежных сервисов для обработки ПДн россиян',
     'critical', 'technical', ('ст. 12 152-ФЗ', 'ст. 18 152-ФЗ'), ('privacy_policy', 'cookie_policy', 'processing_regulation')),
    ('LU-2025-002', '2025-09-01', '2025-09-01', 'Федеральный закон от 14.07.2022 № 266-ФЗ',
     'Согласие на обработку ПДн — отдельный документ',
     'critical', 'consent', ('ст. 9 152-ФЗ',), ('consent_form', 'privacy_policy', 'employee_consent')),
    ('LU-2025-003', '2025-09-01', '2025-09-01', 'Федеральный закон от 14.07.2022 № 266-ФЗ',
     'Обязательная оценка вреда субъектам ПДн',
     'high', 'documentation', ('ст. 18.1 152-ФЗ',), ('harm_assessment', 'processing_regulation')),
    ('LU-2025-004', '2025-09-01', '2025-09-01', 'Федеральный закон от 14.07.2022 № 266-ФЗ, Постановление Правительства РФ от 29.06.2024 № 882',
     'Уведомление Роскомнадзора об инцидентах — 24 часа',
     'high', 'incidents', ('ст. 21 152-ФЗ',), ('incident_instruction', 'processing_regulation')),
    ('LU-2025-005', '2025-05-30', '2025-05-30', 'Федеральный закон от 30.11.2024 № 420-ФЗ',
     'Оборотные штрафы за утечки персональных данных',
     'critical', 'fines', ('ст. 13.11 КоАП РФ', 'ст. 272.1 УК РФ'), ('processing_regulation', 'incident_instruction', 'nondisclosure_agreement', 'harm_assessment')),
    ('LU-2025-006', '2025-09-01', '2025-09-01', 'Федеральный закон от 14.07.2022 № 266-ФЗ',
     'Обязательная локализация баз данных ПДн россиян на территории РФ',
     'high', 'localization', ('ст. 18 ч. 5 152-ФЗ',), ('privacy_policy', 'processing_regulation', 'rkn_notification')),
    ('LU-2025-007', '2025-09-01', '2025-09-01', 'Приказ Роскомнадзора от 28.10.2022 № 180',
     'Новая форма уведомления об обработке ПДн в РКН',
     'medium', 'regulatory', ('ст. 22 152-ФЗ',), ('rkn_notification',)),
    ('LU-2025-008', '2025-03-01', '2025-03-01', 'Постановление Правительства РФ от 01.11.2012 № 1119 (ред. 2024)',
     'Актуализация требований к защите ПДн в ИСПДн',
     'medium', 'security', ('ст. 19 152-ФЗ', 'ПП № 1119'), ('processing_regulation', 'harm_assessment')),
)

# ---------------------------------------------------------------------------
# Document types (key, title, template file, description).
# The employee consent deliberately points at no template.
# ---------------------------------------------------------------------------
DOCUMENT_TYPES = (
    ("privacy_policy", "Политика обработки персональных данных",
     "privacy_policy.md", "Основной публичный документ (ст. 18.1 152-ФЗ)"),
    ("consent_form", "Согласие на обработку персональных данных",
     "consent_form.md", "Форма согласия субъекта ПДн (ст. 9 152-ФЗ)"),
    ("cookie_policy", "Политика использования cookie-файлов",
     "cookie_policy.md", "Политика использования cookie на сайте"),
    ("responsible_person_order", "Приказ о назначении ответственного за обработку ПДн",
     "responsible_person_order.md", "Приказ руководителя (ст. 22.1 152-ФЗ)"),
    ("processing_regulation", "Положение об обработке и защите персональных данных",
     "processing_regulation.md", "Внутреннее положение организации"),
    ("harm_assessment", "Акт оценки вреда субъектам персональных данных",
     "harm_assessment.md", "Акт оценки вреда (Приказ РКН № 178)"),
    ("nondisclosure_agreement", "Обязательство о неразглашении персональных данных",
     "nondisclosure_agreement.md", "Обязательство сотрудника"),
    ("incident_instruction", "Инструкция по реагированию на инциденты",
     "incident_instruction.md", "Порядок действий при утечке ПДн"),
    ("rkn_notification", "Уведомление в Роскомнадзор об обработке ПДн",
     "rkn_notification.md", "Черновик уведомления (ст. 22 152-ФЗ)"),
    ("consent_withdrawal_form", "Форма отзыва согласия на обработку ПДн",
     "consent_withdrawal_form.md", "Форма для отзыва согласия субъектом"),
    ("data_processing_agreement", "Договор поручения обработки персональных данных",
     "data_processing_agreement.md", "Договор с обработчиком ПДн (ст. 6 152-ФЗ)"),
    ("employee_consent", "Согласие сотрудника на обработку персональных данных",
     None, "Письменное согласие работника (ст. 9 ч. 4 152-ФЗ)"),
)
PUBLIC_DOCUMENT_TYPES = ("privacy_policy", "consent_form", "cookie_policy")

# ---------------------------------------------------------------------------
# URL rules
# ---------------------------------------------------------------------------
SKIP_EXTENSIONS = (
    "jpg", "jpeg", "png", "gif", "svg", "webp", "ico",
    "pdf", "doc", "docx", "xls", "xlsx",
    "zip", "rar", "tar", "gz",
    "mp3", "mp4", "avi", "mov", "wmv",
    "woff", "woff2", "ttf", "eot",
    "css", "js", "json", "xml",
)
WELL_KNOWN_POLICY_PATHS = (
    "/privacy-policy", "/privacy_policy", "/privacy",
    "/documents/privacy-policy", "/documents/privacy_policy",
    "/legal/privacy", "/legal/privacy-policy",
    "/info/privacy", "/pages/privacy-policy",
    "/politika-konfidencialnosti", "/obrabotka-personalnyh-dannyh",
    "/personal-data", "/personalnyye-dannyye",
)
POLICY_URL_PRIORITY = (("politika", 4), ("policy", 3), ("privacy", 2), ("personal", 1))
RESEARCH_DOMAINS = (
    "consultant.ru", "garant.ru", "rkn.gov.ru", "pd.rkn.gov.ru", "pravo.gov.ru",
    "publication.pravo.gov.ru", "sozd.duma.gov.ru", "base.garant.ru",
    "www.consultant.ru", "www.garant.ru",
    "habr.com", "vc.ru", "tadviser.ru", "zakon.ru", "klerk.ru", "b152.ru",
    "kdelo.ru", "cntd.ru", "legalacts.ru",
)

# ---------------------------------------------------------------------------
# Page patterns (case-insensitive, Unicode)
# ---------------------------------------------------------------------------
POLICY_URL_PATTERN = (
    r"(privacy|policy|politika|конфиденциальн|персональн|"
    r"personal[\-_]?data|soglashenie|pdn|обработк.{0,10}данн)")
PRIVACY_LINK_PATTERN = (
    r"(полити|конфиденциальн|персональн|privacy|обработк.{0,20}данн|пдн|"
    r"защит.{0,10}данн|пользовател.{0,15}соглаш|legal|terms)")
LEGAL_PATH_PATTERN = r"/(documents?|legal|info|pages?|docs?|terms|rules|politic)/"
LEGAL_TITLE_PATTERN = r"(политик|персональн|конфиденциальн|privacy|пдн|данн|обработк)"
CONSENT_TEXT_PATTERN = r"(согласи|персональн|обработк|пдн|consent|personal\s+data)"
ANALYTICS_URL_PATTERN = r"(google-analytics|googletagmanager|mc\.yandex\.ru|metrika)"
CONSENT_LIBRARY_PATTERN = r"(cookiebot|cookie[\-_]?consent|onetrust|trustarc|complianz)"

# Personal-data categories, in match order
PD_CATEGORIES = (
    ("name", r"(^name$|^fio$|имя|фамилия|отчество|firstname|lastname|middlename|surname|full.?name)"),
    ("email", r"(e[\-_.]?mail|почта|электронн)"),
    ("phone", r"(phone|tel(ephone)?|mobile|телефон|моб)"),
    ("address", r"(address|адрес|город|city|street|улица|индекс|zip|postal)"),
    ("passport", r"(passport|паспорт|серия|номер.?документ)"),
    ("inn", r"(^inn$|^инн$|taxpayer)"),
    ("snils", r"(^snils$|^снилс$)"),
    ("birthday", r"(birth|дата.?рожден|birthday|date.?of.?birth|дата.?р)"),
)

# Cookie-banner id/class patterns in match order, button labels
BANNER_PATTERNS = (
    r"cookie[\-_]?(banner|consent|notice|popup|bar|modal|overlay)",
    r"cookiebot",
    r"cc[\-_]?(banner|window|dialog)",
    r"consent[\-_]?(banner|notice|modal|overlay)",
    r"cookie[\-_]?law",
    r"CybotCookiebot",
    r"onetrust",
    r"cky[\-_]?(consent|container|overlay|banner)",
)
BANNER_ACCEPT_PATTERN = r"(accept|принять|принимаю|agree|согласен|ок|ok|понятно|allow)"
BANNER_DECLINE_PATTERN = (
    r"(reject|отклонить|отказа|отказаться|не\s+соглашаюсь|"
    r"decline|deny|запретить|refuse|only\s+necessary|только\s+необходимые)")
BANNER_SETTINGS_PATTERN = r"(settings|настройк|manage|управлени|preferences|подробнее|выбрать)"

# Form inputs that are not data fields
NON_DATA_INPUT_TYPES = ("hidden", "submit", "button", "reset", "image")

# Main-content selection
MONITOR_DROP_TAGS = ("script", "style", "nav", "header", "footer", "aside", "iframe", "noscript", "svg")
MONITOR_CLASS_PATTERN = r"content|article|post|entry|pricing|features"
MONITOR_ID_PATTERN = r"content|main|article"
RESEARCH_DROP_TAGS = MONITOR_DROP_TAGS + ("form",)
RESEARCH_CLASS_PATTERN = r"content|article|post|entry"
RESEARCH_ID_PATTERN = r"content|article|main"
POLICY_TEXT_MINIMUM = 500

# ---------------------------------------------------------------------------
# Policy-content flags, in check order POLICY_003..POLICY_016.
# A flag holds when every one of its patterns is found.  "raw" flags look at
# the text as written, "lower" flags at the lower-cased text.
# (check_id, flag, text form, patterns)
# ---------------------------------------------------------------------------
POLICY_FLAGS_RU = (
    ("POLICY_003", "has_operator_name", "raw", (
        r"(общество с ограниченной|акционерное общество|индивидуальный предприниматель|ООО|АО|ИП)",)),
    ("POLICY_004", "has_inn_ogrn", "lower", (
        r"(инн\s*[:\-]?\s*\d{10,12}|огрн\s*[:\-]?\s*\d{13,15}|"
        r"inn\s*[:\-]?\s*\d{10,12}|ogrn\s*[:\-]?\s*\d{13,15})",)),
    ("POLICY_005", "has_responsible_person", "lower", (
        r"(ответственн.{0,30}(обработк|организац|персональн)|dpo|data.?protection.?officer|"
        r"(обращени|запрос).{0,30}(данн|персональн))",
        r"([a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}|тел[\s.:]*[\d\s\-\+\(\)]{7,}|"
        r"phone[\s.:]*[\d\s\-\+\(\)]{7,})")),
    ("POLICY_006", "has_data_categories", "lower", (
        r"(категори.{0,20}данн|перечень.{0,20}данн|обрабатыва.{0,30}данн)",)),
    ("POLICY_007", "has_purposes", "lower", (r"(цел.{0,20}обработк|purpose)",)),
    ("POLICY_008", "has_legal_basis", "lower", (
        r"(правов.{0,20}основан|закон.{0,20}основан|legal.?basis|на основании|основан.{0,20}обработк)",)),
    ("POLICY_009", "has_retention_periods", "lower", (
        r"(срок.{0,20}хранен|срок.{0,20}обработк|период.{0,20}хранен)",)),
    ("POLICY_010", "has_subject_rights", "lower", (
        r"(прав.{0,20}субъект|прав.{0,20}пользовател|right.{0,10}data.?subject)",)),
    ("POLICY_011", "has_rights_procedure", "lower", (
        r"(порядок.{0,20}реализац|порядок.{0,20}обращен|10.{0,10}рабочих|направить.{0,20}запрос|"
        r"направить.{0,20}(обращен|заявлен)|требова.{0,30}(уточнени|блокировани|уничтожени))",)),
    ("POLICY_012", "has_cross_border_info", "lower", (
        r"(трансграничн|cross.?border|передач.{0,20}за рубеж|иностранн.{0,20}государств)",)),
    ("POLICY_013", "has_security_measures", "lower", (
        r"(мер.{0,20}безопасност|мер.{0,20}защит|security.?measure|шифрован|encrypt|"
        r"режим.{0,20}защит|защит.{0,10}конфиденциальн)",)),
    ("POLICY_014", "has_cookie_info", "lower", (r"(cookie|куки|файл.{0,10}cookie)",)),
    ("POLICY_015", "has_localization_statement", "lower", (
        r"(территори.{0,30}российской\s+федерации|территори.{0,20}(росс|рф)|"
        r"серверах.{0,10}в\s+росс|хранятся.{0,10}(в\s+рф|в\s+росс)|"
        r"российские.{0,10}серверы|server.{0,20}russia|локализац)",)),
    ("POLICY_016", "has_date", "lower", (
        r"(\d{2}\.\d{2}\.\d{4}|дата.{0,20}(публикац|обновлен|утвержден))",)),
)

# Policy check titles, and messages where they differ from the title
POLICY_FLAG_TITLES = (
    ("POLICY_003", "Полное наименование оператора", None),
    ("POLICY_004", "ИНН/ОГРН оператора", "В политике ПДн не указан ИНН/ОГРН оператора."),
    ("POLICY_005", "Контакт ответственного за обработку ПДн",
     "Не указан контакт ответственного за обработку ПДн."),
    ("POLICY_006", "Категории персональных данных", None),
    ("POLICY_007", "Цели обработки", None),
    ("POLICY_008", "Правовые основания", None),
    ("POLICY_009", "Сроки хранения", None),
    ("POLICY_010", "Права субъектов ПДн", None),
    ("POLICY_011", "Порядок реализации прав", None),
    ("POLICY_012", "Информация о трансграничной передаче", None),
    ("POLICY_013", "Меры безопасности", None),
    ("POLICY_014", "Информация о cookies", None),
    ("POLICY_015", "Локализация данных на территории РФ",
     "Не указана локализация данных на территории РФ (ст. 18 ч. 5)."),
    ("POLICY_016", "Дата публикации/обновления", None),
)

# ---------------------------------------------------------------------------
# Consent and disclosure markers (substrings of lower-cased text)
# ---------------------------------------------------------------------------
OFFER_MARKERS = (
    "публичная оферта", "публичной оферт", "договор оферты", "договор-оферт",
    "условия оферты", "акцептом оферты", "акцепт оферты")
CONSENT_MARKERS = (
    "даю согласие на обработку", "даю своё согласие", "соглашаюсь на обработку",
    "выражаю согласие", "даёт согласие на обработку", "дает согласие на обработку",
    "согласие на обработку персональных")
CONSENT_ELEMENTS = (
    ("оператор", ("оператор", "наименование оператора", "оператором является")),
    ("цели", ("цел", "в целях", "для целей")),
    ("перечень_данных", ("перечень", "фамилия", "имя", "email", "телефон", "адрес")),
    ("сроки", ("срок", "хранени", "в течение", "до момента")),
    ("отзыв", ("отзыв", "отозвать", "прекращени")),
)
WITHDRAWAL_MARKERS = (
    "отзыв согласия", "отозвать согласие", "прекратить обработку",
    "отказаться от обработки", "направив заявление", "направить запрос")
WITHDRAWAL_STEMS = ("отзыв", "отозвать")
MARKETING_STEMS = ("рассылк", "маркетинг", "реклам", "промо", "акци")
CROSS_BORDER_STEMS = (
    "трансграничн", "передача за рубеж", "иностранн", "третьи страны", "зарубежн")

# Service checks TECH_002..TECH_006 (check, service, replacement)
SERVICE_CHECKS = (
    ("TECH_002", "Google Fonts", "Локально размещённые шрифты или fonts.cdnfonts.com"),
    ("TECH_003", "Google Analytics", "Яндекс.Метрика"),
    ("TECH_004", "Facebook Pixel", "VK Pixel, myTarget"),
    ("TECH_005", "Google reCAPTCHA", "Яндекс SmartCaptcha"),
    ("TECH_006", "Google Tag Manager", "Яндекс Метрика контейнер"),
)

# ---------------------------------------------------------------------------
# Change monitoring
# ---------------------------------------------------------------------------
MEANINGFUL_STEMS = (
    "цена", "тариф", "стоимость", "функци", "проверк", "штраф",
    "новый", "новая", "добавил", "обновл", "расширен", "улучшен",
    "бесплатн", "попробуй", "trial", "feature", "price", "pricing")
PRICING_STEMS = ("цена", "тариф", "стоимость", "price", "pricing", "руб", "₽")
FEATURE_STEMS = ("функци", "проверк", "добавил", "feature", "расширен", "улучшен")
LEGAL_STEMS = (
    "персональн", "152-фз", "роскомнадзор", "ркн",
    "закон", "поправк", "изменени", "вступает", "вступил",
    "штраф", "обязан", "требован", "приказ", "постановлен",
    "уведомлен", "обработк", "согласи", "оператор")
CHANGE_TYPES = ("feature", "pricing", "ui", "npa", "minor")
LEGAL_CHANGE_TYPES = ("npa", "minor")

# Severity and checklist-status sort orders
SEVERITY_ORDER = (("critical", 0), ("high", 1), ("medium", 2), ("low", 3), ("info", 4))
STATUS_ORDER = (("fail", 0), ("not_applicable", 1), ("warning", 2), ("manual_check", 3), ("pass", 4))

# Digest and alert wording
THREAT_LABELS = (
    (5, "🔴 КРИТИЧНО"), (4, "🟠 ВЫСОКИЙ"), (3, "🟡 СРЕДНИЙ"),
    (2, "🟢 НИЗКИЙ"), (1, "⚪ МИНИМАЛЬНЫЙ"))
CHANGE_TYPE_LABELS = (
    ("npa", "НПА"), ("feature", "функция"), ("pricing", "цены"),
    ("ui", "интерфейс"), ("minor", "незначительное"))
MESSAGE_LIMIT = 4000
MESSAGE_CUT_SUFFIX = "\n\n_...сообщение обрезано (превышен лимит Telegram)_"

# Score sentences (lowest score of the band, sentence)
SCORE_SENTENCES = (
    (80, "Сайт в целом соответствует требованиям 152-ФЗ, однако выявлены нарушения, требующие внимания."),
    (60, "Сайт имеет существенные нарушения законодательства о персональных данных, требующие устранения."),
    (40, "Сайт имеет серьёзные нарушения 152-ФЗ с высоким риском штрафов со стороны Роскомнадзора."),
    (0, "Критическое несоответствие требованиям 152-ФЗ — необходимо немедленное вмешательство."),
)

# Document filling
REQUIRED_MARK = "[ТРЕБУЕТСЯ ЗАПОЛНИТЬ]"
NO_THIRD_PARTIES = "не передаются"
TEMPLATE_DISCLAIMER = (
    "> ⚠️ **Документ сформирован по шаблону** (LLM недоступен). "
    "Рекомендуется проверить и дополнить вручную.\n\n")
NO_TEMPLATE_TEXT = (
    "Шаблон отсутствует. Сгенерируй документ с нуля, основываясь на "
    "требованиях 152-ФЗ и данных организации. Используй стандартную "
    "структуру для данного типа документа.")
CROSS_BORDER_LISTED = "Осуществляется трансграничная передача данных в следующие страны: "
CROSS_BORDER_UNLISTED = "Осуществляется трансграничная передача персональных данных."
CROSS_BORDER_NONE = "Трансграничная передача персональных данных не осуществляется."
LEGAL_CONTEXT_HEADER = "АКТУАЛЬНЫЕ ИЗМЕНЕНИЯ ЗАКОНОДАТЕЛЬСТВА (обязательно учесть при генерации):"
WEB_CONTEXT_HEADER = (
    "РЕЗУЛЬТАТЫ ОНЛАЙН-ВЕРИФИКАЦИИ ЗАКОНОДАТЕЛЬСТВА "
    "(актуальные данные из интернета, обязательно учесть):")

# Scan-limitation notes
NOTE_NO_FORMS = (
    "Формы: не обнаружены статичным парсером — если сайт использует "
    "клиентский рендеринг (React/Vue/Next.js), формы могут существовать, "
    "но рисоваться через JavaScript. Требуется ручная проверка.")
NOTE_NO_CHECKBOX = (
    "Чекбоксы согласия: не могут быть проверены автоматически — "
    "требуют ручной верификации на страницах с формами.")
NOTE_SPA_CHECKBOX = (
    "Чекбоксы согласия: в SPA-формах (React/Vue) динамические атрибуты "
    "могут не совпадать с HTML-снимком — рекомендуется ручная проверка.")
NOTE_BANNER = (
    "Cookie-баннер: определяется косвенно по тегам <script src> — "
    "если баннер монтируется JS-библиотекой (OneTrust, Cookiebot и др.), "
    "кнопки «Принять»/«Отклонить» могут быть не распознаны. "
    "Рекомендуется проверка в браузере.")
NOTE_POLICY_UNREADABLE = (
    "Политика ПДн найдена в формате PDF, но текст не удалось извлечь "
    "(возможно, сканированный документ или защищённый PDF). "
    "Содержимое политики требует ручной проверки.")

# ---------------------------------------------------------------------------
# Texts of checks and violations; {} stands for a value
# ---------------------------------------------------------------------------
CHECK_TEXTS = {
    "FORM_001": {
        "skipped": "На сайте не обнаружены формы, собирающие персональные данные",
        "details": "Форм с ПДн: {}, без согласия: {}",
        "title": "Форма без согласия на обработку ПДн",
        "description": "На странице {} обнаружена форма, собирающая персональные данные ({}), но без чекбокса согласия."},
    "FORM_002": {
        "details": "Форм с предотмеченным чекбоксом согласия: {}",
        "title": "Чекбокс согласия предотмечен по умолчанию",
        "description": "На странице {} чекбокс согласия установлен заранее: пользователь не выразил "
                       "активного согласия на обработку ПДн."},
    "FORM_003": {
        "details": "Форм без ссылки на Политику: {}",
        "title": "Нет ссылки на Политику обработки ПДн рядом с формой",
        "description": "{} форм(ы) не содержат ссылку на Политику."},
    "FORM_006": {"details": "Требуется ручная проверка наличия отдельного согласия для маркетинга"},
    "FORM_007": {"details": "Форм с >5 полями ПДн: {}"},
    "CONSENT_001": {
        "ok": "Все формы содержат механизм согласия", "details": "Формы без согласия: {}",
        "title": "Формы без механизма получения согласия",
        "description": "Обнаружено {} форм сбора ПДн без чекбокса или текста согласия"},
    "CONSENT_002": {
        "ok": "Согласие не обнаружено в тексте оферты", "details": "Согласие на ПДн включено в текст оферты",
        "title": "Согласие вшито в оферту",
        "description": "Согласие на обработку ПДн включено в текст публичной оферты. "
                       "С 01.09.2025 согласие должно быть отдельным документом"},
    "CONSENT_003": {
        "ok": "Все обязательные реквизиты присутствуют", "details": "Отсутствуют реквизиты: {}",
        "title": "Неполные реквизиты согласия",
        "description": "В тексте согласия отсутствуют обязательные элементы: {}"},
    "CONSENT_004": {
        "ok": "Информация об отзыве согласия найдена",
        "details": "Не найдена информация о порядке отзыва согласия",
        "title": "Нет инструкции по отзыву согласия",
        "description": "На сайте не найдена информация о порядке отзыва согласия на обработку ПДн"},
    "CONSENT_005": {
        "ok": "Раздельные согласия или маркетинговые цели не обнаружены",
        "details": "Маркетинговое согласие не отделено от основного",
        "title": "Смешанное согласие на обработку и маркетинг",
        "description": "Согласие на обработку ПДн и на маркетинговые рассылки объединены в одном "
                       "чекбоксе. С 01.09.2025 требуются раздельные согласия"},
    "COOKIE_001": {
        "ok": "Cookie-баннер обнаружен", "details": "Cookie-баннер не обнаружен",
        "title": "Отсутствует cookie-баннер",
        "description": "На сайте не обнаружен механизм получения согласия на использование cookie."},
    "COOKIE_002": {
        "ok": "Кнопка 'Отклонить' есть", "details": "Кнопка 'Отклонить' нет",
        "title": "Cookie-баннер без возможности отказа",
        "description": "Cookie-баннер обнаружен, но не содержит равноценной кнопки отклонения. "
                       "Пользователь лишён возможности отказаться от необязательных cookie."},
    "COOKIE_003": {"ok": "Выбор категорий cookie: есть", "details": "Выбор категорий cookie: нет"},
    "COOKIE_005": {
        "details": "Аналитика загружается до получения согласия",
        "title": "Аналитика загружается до согласия на cookie",
        "description": "Скрипты аналитики загружаются до получения согласия пользователя."},
    "POLICY_001": {
        "ok": "Политика обработки ПДн найдена", "details": "Политика обработки ПДн не найдена",
        "title": "Политика обработки ПДн не опубликована",
        "description": "На сайте не обнаружена Политика обработки персональных данных."},
    "POLICY_002": {
        "details": "Страниц без ссылки на Политику в футере: {}/{}",
        "title": "Ссылка на Политику отсутствует в футере",
        "description": "{} из {} страниц не имеют ссылки на Политику в футере."},
    "POLICY_017": {"ok": "Политика на отдельной странице: да", "details": "Политика на отдельной странице: нет"},
    "TECH_001": {
        "ok": "HTTPS активен", "details": "HTTPS не настроен", "title": "Сайт не использует HTTPS",
        "description": "Сайт не защищён SSL-сертификатом."},
    "TRACKER_001": {
        "unreadable": "Не применимо: текст политики ПДн недоступен для анализа",
        "details": "Не упомянуты в политике: {}",
        "ok": "Все обнаруженные трекеры упомянуты в политике ПДн", "none": "Трекеры из реестра не обнаружены",
        "title": "Трекеры не упомянуты в политике обработки ПДн",
        "description": "На сайте подключены сервисы, обрабатывающие данные пользователей, но они не "
                       "упоминаются в политике обработки ПДн: {}. Субъект ПДн не был проинформирован "
                       "об этих обработчиках.",
        "advice": "Добавить в политику ПДн раздел о третьих лицах, которым передаются данные, "
                  "с указанием каждого сервиса: {}."},
    "TRACKER_002": {
        "details": "Иностранные трекеры без раскрытия трансграничной передачи: {}",
        "ok": "Трансграничная передача данных раскрыта в политике",
        "none": "Иностранные трекеры из реестра не обнаружены",
        "title": "Иностранные трекеры без раскрытия трансграничной передачи данных",
        "description": "На сайте подключены иностранные сервисы ({}), передающие данные пользователей "
                       "за рубеж, однако политика обработки ПДн не содержит информации о "
                       "трансграничной передаче данных.",
        "advice": "Добавить в политику ПДн раздел о трансграничной передаче данных с указанием "
                  "стран назначения и правовых оснований передачи для следующих сервисов: {}."},
    "REG_001": {"details": "Требуется ручная проверка: оператор зарегистрирован в реестре РКН"},
    "REG_002": {"details": "Требуется ручная проверка: уведомление об обработке ПДн подано в РКН"},
    "REG_003": {"details": "Требуется ручная проверка: хостинг на территории РФ"},
}
FORMS_SKIPPED = "Не применимо: формы, собирающие ПДн, не обнаружены"
CONSENT_SKIPPED = "Формы сбора ПДн не обнаружены"
COOKIES_SKIPPED = "Не применимо: cookie-баннер не обнаружен"
POLICY_SKIPPED = "Не применимо: политика обработки ПДн не найдена на сайте"
POLICY_UNREADABLE = (
    "Требуется ручная проверка: текст политики недоступен для "
    "автоматического анализа (PDF-документ не удалось прочитать)")
POLICY_FLAG_TITLE = "В Политике отсутствует: {}"
POLICY_FLAG_DESCRIPTION = "Политика обработки ПДн не содержит обязательного раздела: {}."
SERVICE_FOUND, SERVICE_ABSENT = "{}: обнаружен", "{}: не обнаружен"
SERVICE_TITLE = "Использование запрещённого сервиса: {}"
SERVICE_DESCRIPTION = "На сайте обнаружено подключение {}, что запрещено с 01.07.2025."
SERVICE_ADVICE = "Заменить {} на {}."
FINE_RANGE = "{} – {} руб."
FALLBACK_SUMMARY = (
    "Обнаружено нарушений: {} (критических: {}, высокой серьёзности: {}). Требуется детальная проверка.")
SUMMARY_WORDS = {
    "banner": ("обнаружен", "не обнаружен"), "policy": ("найдена", "не найдена"), "https": ("да", "нет"),
    "no_violations": "Нарушений не обнаружено"}

# Digest, alert, legal-context and search-result formats
DIGEST_DIVIDER = "─" * 24
DIGEST_HEADER = "📋 *Дайджест изменений — {}*\n\nИтоговый уровень угрозы: {}\n\n"
DIGEST_LEGAL_SECTION = "🏛 *НПА — нормативные изменения*"
DIGEST_COMPETITOR_SECTION = "🏢 *Конкуренты*"
DIGEST_EMPTY_SECTION = "_нет изменений за период_"
DIGEST_CRITICAL_BADGE = "⚠️ *КРИТИЧНО*  •  {}"
DIGEST_META = "_Тип: {}  •  Угроза: {}_"
DIGEST_NO_SUMMARY = "_описание не сформировано_"
DIGEST_LINK = "🔗 {}"
THREAT_UNKNOWN, THREAT_OTHER, THREAT_OF_FIVE = "❓ не определён", "❓ {}", "{} ({}/5)"
ALERT_HEADER = "⚠️ *НПА — критическое изменение*"
ALERT_SOURCE, ALERT_THREAT, ALERT_URL = "*Источник:* {}", "*Уровень угрозы:* {}", "*URL:* {}"
ALERT_CHANGE, ALERT_NO_SUMMARY = "*Изменение:*", "нет описания"
ALERT_ACTION = "\n*Требуемые действия:*\n{}"
CONTEXT_UPDATE = "### {}\nВступило в силу: {}\nИсточник: {}\nСтатьи: {}\nСуть: {}"
CONTEXT_REQUIREMENTS = "Требования:"
UPDATE_BLOCK = "Изменение: {}\nИсточник: {}\nДата вступления в силу: {}\nЗатронутые статьи: {}\nОписание: {}"
UPDATE_REQUIREMENTS = "Новые требования:"
HIT_HEADER = "--- Результат {} ---\n"
HIT_BLOCK = "Источник: {}\nЗаголовок: {}\nСодержание: {}\n"
DIFF_LABELS = ("Текущая версия", "Обновлённая версия")
MISSING_TEMPLATE = "Шаблон {} не найден. Сгенерируй документ с нуля, основываясь на требованиях 152-ФЗ."
EMPTY_DOCUMENT = "Document has no content"
