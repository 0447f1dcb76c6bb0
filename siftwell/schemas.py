"""Input and table schemas."""

from pyspark.sql import types as T

_s, _d, _l, _b, _ts = (T.StringType(), T.DoubleType(), T.LongType(), T.BooleanType(), T.TimestampType())
_arr = T.ArrayType(T.StringType())


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, typ, True) for name, typ in fields.items()])


POSTING_DETAILS = _struct(
    descriptionText=_s, seniorityLevel=_s, employmentType=_s, jobFunction=_s, industries=_s,
    numApplicants=_s,
)

# A landed posting in any of the accepted spellings.
RAW_POSTING = _struct(
    id=_s, link=_s, jobUrl=_s, title=_s, position=_s, companyName=_s, company=_s,
    companyDescription=_s, location=_s, postedAt=_s, date=_s, salary=_s, descriptionText=_s,
    applicantsCount=_s, applyUrl=_s, seniorityLevel=_s, employmentType=_s, jobFunction=_s,
    industries=_s, benefits=_arr, source=_s, agoTime=_s, companyLogo=_s, details=POSTING_DETAILS,
)

ENVELOPE = _struct(
    platform=_s, keyword=_s, location=_s, scrapedAt=_s, count=_l, jobs=T.ArrayType(RAW_POSTING),
)

# Facts extracted from one posting.
FACTS = _struct(
    job_domain=_s, min_required_yoe=_d, max_required_yoe=_d, required_skills=_arr,
    preferred_skills=_arr, candidate_matched_required_skills=_arr,
    candidate_matched_preferred_skills=_arr, domain_matches_candidate=_b, job_location=_s,
    direct_apply=_s,
)

PROJECT = _struct(project_title=_s, project_description=_s)

USERS = _struct(
    id=_s, email=_s, name=_s, phone=_s, resume_key=_s, chat_id=_s,
    credentials=_struct(accessToken=_s, refreshToken=_s, personUrn=_s), post_template=_s,
    tier=_s, subscription_amount=_d, subscription_expires_at=_ts, experience_years=_d,
    profile_url=_s, target_locations=_s, employment_type=_s, primary_domain=_s,
    candidate_summary=_s, known_skills=_arr, education=_arr, projects=T.ArrayType(PROJECT),
    certifications=_arr, key_highlights=_arr, suggested_job_titles=_arr,
    exclude_title_keywords=_arr, is_active=_b, source=_s, total_runs_count=T.IntegerType(),
    last_run_at=_ts, telegram_apply_clicks=T.IntegerType(), telegram_resume_clicks=T.IntegerType(),
    dashboard_apply_clicks=T.IntegerType(), dashboard_resume_clicks=T.IntegerType(),
    created_at=_ts, updated_at=_ts,
)

LEDGER = _struct(
    id=_s, user_id=_s, job_link=_s, fingerprint=_s, created_at=_ts, updated_at=_ts, job_title=_s,
    company_name=_s, location=_s, posted_at=_s, salary=_s, ai_score=T.IntegerType(), ai_reason=_s,
    job_domain=_s, min_required_yoe=_d, max_required_yoe=_d, required_skills=_arr,
    preferred_skills=_arr, candidate_matched_required_skills=_arr,
    candidate_matched_preferred_skills=_arr, candidate_missing_required_skills=_arr,
    candidate_missing_preferred_skills=_arr, domain_matches_candidate=_b, ai_job_location=_s,
    direct_apply=_s, applicants_count=_s, description_key=_s, resume_key=_s, source=_s,
)

RUNS = _struct(
    user_id=_s, run_at=_ts, status=_s, scraped_jobs_count=_l, batch_dedup_count=_l,
    db_dedup_count=_l, keyword_filtered_count=_l, rejected_jobs_count=_l, matched_jobs_count=_l,
    actual_cost_usd=_d, input_tokens=_l, input_cache_hit_tokens=_l, output_tokens=_l,
    reasoning_tokens=_l, error_message=_s, exit_stage=_s,
)

CLICK = _struct(jobId=_s, userId=_s, source=_s, type=_s, ts=_ts)

LOG_BATCH = _struct(
    logGroup=_s, logEvents=T.ArrayType(_struct(timestamp=_l, message=_s)),
)

# JSON embedded in a result page. Salary arrives as text or as an object, so it is kept raw.
EMBEDDED_JOB = _struct(
    jobKey=_s, title=_s, snippet=_s, company=_s, location=_s, salaryInfo=_s, dateOnIndeed=_s,
    encodedUrl=_s, jobTypes=_arr, benefits=_arr,
)
EMBEDDED_VIEW = _struct(
    jobDescriptionHtml=_s, compensation=_struct(raw=_s), datePublished=_s, employerName=_s,
    formattedLocation=_s, jobTypes=_arr,
)
EMBEDDED_PAGE = _struct(props=_struct(pageProps=_struct(
    jobs=T.ArrayType(EMBEDDED_JOB), viewJobData=EMBEDDED_VIEW,
    pageCursors=T.MapType(_s, _s),
)))

RESUME = _struct(
    contact_details=T.MapType(_s, _s), summary=_s,
    experience=T.ArrayType(_struct(title=_s, company=_s, dates=_s, bullets=_arr)),
    skills=_arr,
    education=T.ArrayType(_struct(degree=_s, institution=_s, dates=_s)),
    projects=T.ArrayType(_struct(name=_s, description=_s, technologies=_arr)),
    changes_made=_arr, ats_keywords_used=_arr,
)

PROFILE = _struct(
    candidateName=_s, candidateEmail=_s, candidatePhone=_s, experienceYears=_d, primaryDomain=_s,
    candidateSummary=_s, knownSkills=_arr, education=_arr, projects=T.ArrayType(PROJECT),
    certifications=_arr, keyHighlights=_arr, suggestedJobTitles=_arr, excludeTitleKeywords=_arr,
)
